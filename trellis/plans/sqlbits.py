"""Shared SQL text for the DuckDB twins of the registered queries."""

RUNS = 30


def h32(expr: str) -> str:
    """md5-based unsigned 32-bit hash of a text expression (twin of ``hash32``)."""
    return f"CAST('0x' || substr(md5({expr}), 1, 8) AS BIGINT)"


def v(col: str) -> str:
    return f"CAST({col} AS VARCHAR)"


def keyed(*parts: str) -> str:
    """``a || ':' || b ...`` of already-text expressions."""
    return " || ':' || ".join(parts)


SEED = "CAST(run + 41 AS VARCHAR)"
RUNS_CTE = f"runs AS (SELECT CAST(range AS BIGINT) AS run FROM range(1, {RUNS + 1}))"
TEST_CUT = "0.2 * 4294967296.0"
LINEITEM_KEY = ("concat_ws(':', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
                "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR))")


def r6(expr: str, alias: str, digits: int = 6) -> str:
    # "+ 0.0" turns a rounded -0.0 into 0.0, as Spark's decimal rounding does
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0) AS {alias}"


def seeded(key_hash: str, seed: str = "run + 41") -> str:
    """SQL twin of ``seeded_hash`` (per-row key hash, per-run seed)."""
    from trellis.functions.random import sql_seeded_hash
    return sql_seeded_hash(key_hash, seed)
