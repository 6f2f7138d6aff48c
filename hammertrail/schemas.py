"""Explicit schemas of the ingested records."""

from __future__ import annotations

from pyspark.sql import types as T

LOTS_CSV = T.StructType(
    [
        T.StructField("id", T.IntegerType()), T.StructField("brand", T.StringType()),
        T.StructField("model", T.StringType()), T.StructField("version", T.StringType()),
        T.StructField("reference", T.StringType()), T.StructField("city", T.StringType()),
        T.StructField("mileage", T.IntegerType()), T.StructField("startingPrice", T.DoubleType()),
        T.StructField("soldPrice", T.DoubleType()), T.StructField("status", T.StringType()),
        T.StructField("sourceUrl", T.StringType()),
    ]
)

# Detail record: field name and JSON kind; the first five are required.
DETAIL_FIELDS = {
    "brand": "string", "model": "string", "year": "number", "mileage": "number", "sourceUrl": "string",
    "reference": "string", "hashId": "string", "version": "string", "color": "string", "fuel": "string",
    "transmission": "string", "engineSize": "number", "power": "number", "fiscalPower": "number",
    "doors": "number", "seats": "number", "co2": "number", "critair": "string", "euroStandard": "string",
    "bodyType": "string", "startingPrice": "number", "startingPriceHT": "number", "marketValue": "number",
    "newPrice": "number", "currentAuctionPrice": "number", "vatRecoverable": "boolean", "city": "string",
    "center": "string", "department": "string", "saleDate": "string", "saleTime": "string",
    "lotNumber": "number", "technicalCheckUrl": "string", "conditionImageUrl": "string",
    "observations": "string", "maintenanceStatus": "string", "serviceHistory": "boolean",
    "firstOwner": "boolean", "warranty": "string", "equipment": "strings", "photoUrls": "strings",
    "cdnHash": "string", "status": "string", "soldPrice": "number",
}
DETAIL_REQUIRED = ["brand", "model", "year", "mileage", "sourceUrl"]
DETAIL_DEFAULTS = {
    "version": "", "color": "", "fuel": "", "transmission": "", "city": "", "status": "available",
    "vatRecoverable": False,
}

LIST_FIELDS = {
    "hashId": "string", "reference": "string", "brand": "string", "model": "string", "version": "string",
    "year": "coerced", "mileage": "coerced", "power": "number", "transmission": "string", "city": "string",
    "startingPrice": "number", "currentAuctionPrice": "number", "soldPrice": "number", "status": "string",
    "observations": "string", "lotNumber": "number", "sourceUrl": "string", "cdnHash": "string",
    "photoUrls": "strings",
}
LIST_NULLABLE = [
    "reference", "power", "transmission", "startingPrice", "currentAuctionPrice", "soldPrice",
    "observations", "lotNumber", "cdnHash",
]
LIST_DEFAULTS = {
    "brand": "", "model": "", "version": "", "year": 0, "mileage": 0, "city": "", "status": "available",
    "sourceUrl": "",
}
