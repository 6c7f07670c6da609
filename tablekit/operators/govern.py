"""Column governance: masking, encryption, text cleaning, audit rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablekit.functions.columns import col

SENSITIVITIES = ("public", "internal", "confidential", "restricted")


def mask_text(value: Column, sensitivity: str) -> Column:
    level = sensitivity.lower()
    if level == "restricted":
        return F.when(value.isNotNull(), F.lit("******"))
    if level == "confidential":
        kept = F.concat(F.substring(value, 1, 2), F.lit("****"), F.right(value, F.lit(2)))
        return F.when(F.length(value) <= 4, F.lit("****")).otherwise(kept)
    return value


def mask_value(value: Column, kind: T.DataType, sensitivity: str) -> Column:
    """Mask strings wherever they sit: plain, in arrays, in structs, as map values."""
    if isinstance(kind, T.StringType):
        return mask_text(value, sensitivity)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: mask_value(x, kind.elementType, sensitivity))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: mask_value(v, kind.valueType, sensitivity))
    if isinstance(kind, T.StructType):
        fields = [mask_value(value[f.name], f.dataType, sensitivity).alias(f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def mask_columns(df: DataFrame, levels: dict[str, str]) -> DataFrame:
    """Mask each column by its sensitivity; public, internal and unknown levels leave it as it is."""
    return df.withColumns({c: mask_value(col(c), df.schema[c].dataType, s) for c, s in levels.items()})


def _key(secret: str) -> Column:
    return F.unhex(F.sha2(F.lit(secret), 256))


def encrypt_columns(df: DataFrame, columns: list[str], secret: str) -> DataFrame:
    """AES-256-GCM with a fresh nonce per value, base64 text; empty strings stay empty."""
    return df.withColumns(
        {
            c: F.when(col(c) == "", F.lit("")).when(col(c).isNotNull(), F.base64(F.aes_encrypt(col(c), _key(secret), F.lit("GCM"))))
            for c in columns
        }
    )


def decrypt_columns(df: DataFrame, columns: list[str], secret: str) -> DataFrame:
    return df.withColumns(
        {
            c: F.when(col(c) == "", F.lit("")).when(
                col(c).isNotNull(), F.aes_decrypt(F.unbase64(col(c)), _key(secret), F.lit("GCM")).cast("string")
            )
            for c in columns
        }
    )


# -- text -------------------------------------------------------------------------------------------

#: Markup that is removed, case-insensitively, in this order (fixed values).
SCRIPT_PATTERNS = (
    r"<script[^>]*>.*?</script>",
    r"javascript:",
    r"on\w+\s*=",
    r"<iframe",
    r"<object",
    r"<embed",
)

#: HTML escapes, ampersand first (fixed values).
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def strip_markup_characters(text: Column, max_length: int | None = None) -> Column:
    """Drop < > " ' &, and cut to max_length characters where one is given."""
    text = F.regexp_replace(text, r"[<>\"'&]", "")
    return text if max_length is None else F.substring(text, 1, max_length)


def strip_scripts(text: Column) -> Column:
    for pattern in SCRIPT_PATTERNS:
        text = F.regexp_replace(text, "(?is)" + pattern, "")
    return text


def escape_html(text: Column) -> Column:
    for plain, escaped in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


# -- audit ------------------------------------------------------------------------------------------

FAILED_LOGIN, REJECTED_UPLOAD = "authentication_attempt", "file_upload_rejected"


def audit_rollup(events: DataFrame, ts: str = "ts", kind: str = "event_type", severity: str = "severity", every: str = "1 day") -> DataFrame:
    """(window_start, event_type, severity, n) per tumbling window; works on streams too."""
    return (
        events.groupBy(F.window(col(ts), every).alias("w"), col(kind).alias("event_type"), col(severity).alias("severity"))
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "event_type", "severity", "n")
    )


def address_alerts(events: DataFrame, address: str = "ip_address", kind: str = "event_type", success: str = "success") -> DataFrame:
    """(ip_address, failed_logins, rejected_uploads) for addresses with at least one of them."""
    failed = (col(kind) == FAILED_LOGIN) & ~col(success)
    rejected = col(kind) == REJECTED_UPLOAD
    return (
        events.filter(failed | rejected)
        .groupBy(col(address).alias("ip_address"))
        .agg(F.count_if(failed).alias("failed_logins"), F.count_if(rejected).alias("rejected_uploads"))
    )
