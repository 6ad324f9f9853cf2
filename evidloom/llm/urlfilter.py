"""URL filter: host and path rules, then a blocked Bloom filter over listed URLs with an exact join.

Built-in functions and joins only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import fits, salted_join

#: Bits set per key in its block, and words of 64 bits per block.
PROBES, WORDS = 8, 4
KEYS_PER_BLOCK = 12


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without leading www. or m., path without .html and closing slashes; scheme, query and fragment are gone."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(F.regexp_replace(path, r"\.html$", ""), r"/+$", ""))


def rule_column(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, or null: a rule fits its host, all subdomains, and paths that start with its path."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits_ = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits_, F.lit(r.text)).otherwise(out)
    return out


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(h, F.lit(blocks)).alias("block")


def _masks(key: Column) -> list[Column]:
    """The key's bits in each word of its block, from a second hash."""
    h = F.xxhash64(F.lit("probe"), key)
    out = []
    for w in range(WORDS):
        mask = F.lit(0).cast("long")
        for k in range(PROBES // WORDS):
            bit = F.shiftrightunsigned(h, 6 * (w * (PROBES // WORDS) + k)).bitwiseAND(F.lit(63)).cast("int")
            mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
        out.append(mask)
    return out


def bloom_filter(listed: DataFrame, url_col: str, blocks: int) -> DataFrame:
    """(block, w0..w3): one row per non-empty block of 256 bits."""
    keyed = listed.select(F.col(url_col).alias("u")).where("u is not null").select(_block(F.xxhash64("u"), blocks), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("u")))])
    return keyed.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every page.

    A fitting rule decides; otherwise a page is blocked if its canonical URL is
    in `listed`.  The Bloom filter passes all listed URLs and few others to the
    exact join, which removes the false ones.  Its blocks grow with the list;
    filter and list are broadcast only when their row count is checked to be
    small, else both joins are shuffled, with blocks and URLs that many pages
    share salted.  A null url, or one without ://, has an empty host and path and
    is never listed.  Repeated pages are judged each; very long urls whole; an
    empty list blocks nothing; other columns are ignored; an empty table gives an empty result.
    """
    listed = listed.select(F.col(listed_col).alias("u")).where("u is not null and u <> ''").distinct()
    n = listed.count()
    blocks = max(1, -(-n // KEYS_PER_BLOCK))
    small = fits(listed)
    base = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    base = base.select("*", rule_column(F.col("host"), F.col("path"), rules).alias("rule"), canonical(F.col("host"), F.col("path")).alias("u"))
    base = base.select("*", _block(F.xxhash64("u"), blocks), *[m.alias(f"m{i}") for i, m in enumerate(_masks(F.col("u")))])
    bloom = bloom_filter(listed, "u", blocks)
    possible = F.lit(True)
    for i in range(WORDS):
        possible = possible & (F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"))
    probe = F.when(F.coalesce(possible, F.lit(False)), F.col("u"))
    exact = listed.select(F.col("u").alias("probe"), F.lit(True).alias("listed"))
    if small:
        out = base.join(F.broadcast(bloom), "block", "left").withColumn("probe", probe).join(F.broadcast(exact), "probe", "left")
    else:  # rows that cannot be listed stay out of the shuffles
        urls = base.where("u <> ''")
        met = bloom.join(urls.groupBy("block").agg(F.count("*").alias("n")), "block")
        urls = salted_join(urls, met, "block", "n", ["page_id", "path"], "left").withColumn("probe", probe)
        hits = urls.where("probe is not null")
        wanted = exact.join(hits.groupBy("probe").agg(F.count("*").alias("n")), "probe")
        hits = salted_join(hits, wanted, "probe", "n", ["page_id", "host"], "left")
        others = urls.where("probe is null").unionByName(base.where("u = ''"), allowMissingColumns=True)
        out = hits.unionByName(others.withColumn("listed", F.lit(False)))
    verdict = F.lit("allow")
    for kind in ("allow", "block"):
        texts = [r.text for r in rules if r.verdict == kind]
        verdict = F.when(F.col("rule").isin(texts), F.lit(kind)).otherwise(verdict) if texts else verdict
    verdict = F.when(F.col("rule").isNotNull(), verdict).when(F.coalesce("listed", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("listed", F.lit(False)).alias("listed"))
