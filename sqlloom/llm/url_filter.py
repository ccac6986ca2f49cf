"""URL rules behind a blocked Bloom filter, with DataFrame functions only.

The listed canonical URLs (host and path prefix) go into a blocked Bloom filter: a table of 256-bit blocks,
of which a key's first hash chooses one and its second sets ``PROBES`` bits. A page's URL asks for the keys
that could list it (its host and the parents of it, each with the path lengths that occur in the list).
Keys that the filter passes go to an exact hash join with the list, which removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blocks of 4 longs; listed keys for each block; bits that a key sets in its block.
LONGS, KEYS_PER_BLOCK, PROBES = 4, 16, 6
#: The filter and the list are broadcast up to this many rows (blocks, or rules), else joined by shuffle.
BROADCAST_ROWS = 1 << 18


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: host up to ``/?#`` (A-Z lower-cased), path up to ``?#``; both empty without it."""
    text = F.coalesce(url, F.lit(""))
    found = F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _bits(key: str) -> list[Column]:
    """For each long of a block, the bits that ``key`` sets there."""
    second = f"xxhash64({key}, 'bits')"
    return [F.expr(" | ".join(f"if(shiftright({second}, {8 * p + 6}) & {LONGS - 1} = {word}, shiftleft(1L, cast(shiftright({second}, {8 * p}) & 63 as int)), 0L)" for p in range(PROBES))) for word in range(LONGS)]


def bloom_blocks(rules: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0..w3) of the non-empty blocks; rules has the column key."""
    bits = rules.select(F.expr(f"pmod(xxhash64(key), {n_blocks})").alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits("key"))])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(LONGS)])


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    ``rules``: host, path, verdict. A rule fits its host and all subdomains, if the path starts with the
    rule's; the longest (host and path together) wins, among equals the first by text. A URL that no rule
    fits is not listed and gets ``default``. A null URL and one without ``://`` have an empty host and
    path and fit nothing. Rows repeated, or with a null page_id, give one row each; a rule that is
    repeated, or has a null part, counts once, or not at all.
    """
    rules = rules.dropna(subset=["host", "path", "verdict"]).where("host not rlike '[/?#]' and (path = '' or path like '/%')")
    rules = rules.groupBy("host", "path").agg(F.min("verdict").alias("ruled")).withColumn("key", F.concat("host", "path"))
    listed = rules.agg(F.count("*").alias("n"), F.collect_set(F.char_length("path")).alias("lengths")).first()
    n_rules, lengths = listed["n"], sorted(listed["lengths"])
    n_blocks = max(1, -(-n_rules // KEYS_PER_BLOCK))
    host, path = host_and_path(F.col("url"))
    asked = pages.select("page_id", host.alias("host"), path.alias("path"))
    parents = "transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, 1000000), '.'))"
    starts = "filter(array(" + ", ".join(f"if(char_length(path) >= {n}, left(path, {n}), null)" for n in lengths) + "), p -> p is not null)" if lengths else "cast(array() as array<string>)"
    keys = asked.where("host <> ''").select("host", "path", F.explode(F.expr(f"flatten(transform({parents}, h -> transform({starts}, p -> concat(h, p))))")).alias("key"))
    blocks = _small(bloom_blocks(rules, n_blocks), n_blocks)
    tested = keys.withColumn("block", F.expr(f"pmod(xxhash64(key), {n_blocks})")).join(blocks, "block")
    all_set = F.lit(True)
    for i, bits in enumerate(_bits("key")):
        all_set = all_set & (bits.bitwiseAND(F.col(f"w{i}")) == bits)
    hits = tested.where(all_set).select("host", "path", "key").join(_small(rules.select("key", "ruled"), n_rules), "key")
    best = hits.groupBy("host", "path").agg(F.min(F.struct((-F.char_length("key")).alias("length"), F.col("key").alias("rule"), "ruled")).alias("best"))
    return asked.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.ruled", F.lit(default)).alias("verdict"))


#: The rules of the contract.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def contract_rules(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return spark.sql(f"select * from values {rows} as t(host, path, verdict)")
