"""SQL that several oracles share."""

from granary.operators.resampling import POISSON

#: How often a resample draws a row: a Poisson law of mean one over the hash of seed, iteration and key.
DRAWN = "(" + " + ".join(f"CAST(u >= {x!r} AS INT)" for x in POISSON) + ")"
RESAMPLED = "CAST(('0x' || substr(md5('42|' || i || '|' || {key}), 1, 8)) AS BIGINT) / 4294967296.0"


def _crc_table() -> list[int]:
    """The table of crc32, from its polynomial."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def simhash_sql(rows: str, key: str, text: str) -> str:
    """SQL for (key, hash) of a table's texts: crc32 of each different gram of three characters once, then majorities of bits."""
    bits = " + ".join(f"CASE WHEN 2 * sum(crc >> {k} & 1) > count(*) THEN {1 << k} ELSE 0 END" for k in range(32))
    return f"""(WITH t AS (SELECT {key} AS key, substr({text}, 1, 800) AS t FROM {rows}), g AS (SELECT key, unnest(CASE WHEN length(t) > 3 THEN list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)) ELSE [t] END) AS g FROM t),
  d AS (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM g)), b AS (SELECT g, list_transform(range(1, length(h) // 2 + 1), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT)) AS b FROM d),
  c AS (SELECT g, xor(list_reduce(b, lambda s, x: xor(s >> 8, ({_crc_table()})[1 + (xor(s, x) & 255)]), CAST(4294967295 AS BIGINT)), 4294967295) AS crc FROM b)
  SELECT key AS {key}, CAST({bits} AS BIGINT) AS hash FROM g JOIN c USING (g) GROUP BY key)"""
