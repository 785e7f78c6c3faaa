"""SQL functions over addresses and digests, registered as expressions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFINITIONS = {
    "align_up": ("v BIGINT, a BIGINT", "BIGINT", "v + pmod(-v, a)"),
    "align_down": ("v BIGINT, a BIGINT", "BIGINT", "v - pmod(v, a)"),
    "in_range": ("v BIGINT, lo BIGINT, hi BIGINT", "BOOLEAN", "v >= lo AND v < hi"),
    "base_mnemonic": ("m STRING", "STRING", "element_at(split(m, ' '), -1)"),
    "pic_hash_hex": ("digest STRING", "STRING", "substring(digest, 1, 16)"),
    "api_name": ("dll STRING, api STRING", "STRING", "concat(dll, '!', api)"),
    "hex_value": ("s STRING", "BIGINT", "CAST(conv(regexp_extract(s, '0x([0-9a-fA-F]+)', 1), 16, 10) AS BIGINT)"),
}


def register(spark: SparkSession) -> list[str]:
    for name, (params, returns, body) in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")
    return sorted(DEFINITIONS)
