"""URL filters: rules by host and path, and a blocked Bloom filter before an exact join with listed URLs.

A url is looked up by its canonical form and by the root of its host and of
every parent host with two labels or more; the list holds canonical URLs of
pages or of whole sites. One 64-bit word of the filter answers for a key, with
four bits set in it. The words, whose number is bounded, are an array that
the scan of the pages tests in place; only urls that may be listed go on, each
once, to an exact hash join with the list, which drops the false positives.
Where a url stands on very many pages, its verdict is joined back by broadcast.

A null url, or one without ``://``, has empty host and path, fits no rule and
is never listed. Of rules that fit, the longest wins, and of equally long ones
the last in the alphabet. Repeated and null ids are judged row by row, urls of
any length whole; extra columns are ignored; an empty table or list is fine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import cut, join_unique

#: Words of the Bloom filter: one for four listed URLs, and this many (8 MB) at most.
MAX_WORDS = 1 << 20
#: Broadcast a list of URLs up to so many; beyond, it is shuffled.
BROADCAST_URLS = 100_000
BITS = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that do not name a page.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    has = url.contains("://")
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.when(has, host).otherwise(""), F.when(has, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def canonical(url: Column) -> Column:
    """Host, path without trailing slash (a bare host keeps one), and the query without tracking parameters, sorted."""
    host, path = host_and_path(url)
    trimmed = F.regexp_replace(path, "/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, F.when((trimmed == "") & (kept == ""), "/").otherwise(trimmed), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def lookup_keys(url: Column) -> Column:
    host, _ = host_and_path(url)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(labels, i, F.size(labels)), "."), F.lit("/")))
    return F.array_distinct(F.concat(F.array(canonical(url)), parents))


def _bloom(exact: DataFrame, words: int) -> np.ndarray:
    """The words of the filter, whose number is bounded; a key's word and bits come from its 64-bit hash."""
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned("h", 6 * k).bitwiseAND(63).cast("int"))
    mask = one(0)
    for k in range(1, BITS):
        mask = mask.bitwiseOR(one(k))
    rows = exact.select(F.xxhash64("key").alias("h")).select(F.shiftrightunsigned("h", 32).bitwiseAND(words - 1).alias("word"), mask.alias("mask"))
    found = rows.groupBy("word").agg(F.bit_or("mask").alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _passes(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    mask = np.zeros(len(h), np.uint64)
    for k in range(BITS):
        mask |= np.uint64(1) << (h >> np.uint64(6 * k) & np.uint64(63))
    return words[h >> np.uint64(32) & np.uint64(len(words) - 1)] & mask == mask


class Listed:
    """A list of canonical URLs, in its column ``url``: its filter, and itself for the exact join."""

    def __init__(self, listed: DataFrame, max_words: int = MAX_WORDS):
        self.exact = cut(listed.select(F.col("url").alias("key")).where("key is not null").distinct())
        self.n = self.exact.count()
        self.shared = listed.sparkSession.sparkContext.broadcast(_bloom(self.exact, min(max_words, 1 << max(6, (self.n // 4).bit_length()))))

    def may_hold(self, url: Column) -> Column:
        """Whether a key of the url passes the filter."""
        shared = self.shared

        def run(hashes: pa.Array) -> pa.Array:
            hits = np.concatenate(([0], np.cumsum(_passes(hashes.flatten().to_numpy().view(np.uint64), shared.value))))
            ends = np.cumsum(pc.list_value_length(hashes).to_numpy())
            return pa.array(hits[ends] > hits[np.concatenate(([0], ends[:-1]))] if len(ends) else [], pa.bool_())

        keys = F.when(url.contains("://"), F.transform(lookup_keys(url), lambda k: F.xxhash64(k))).otherwise(F.array().cast("array<bigint>"))
        return F.arrow_udf(run, "boolean")(F.coalesce(keys, F.array().cast("array<bigint>")))

    def holding(self, urls: DataFrame) -> DataFrame:
        """The distinct urls of those in ``urls`` that are listed."""
        looked = urls.select("url").distinct().select("url", F.explode(lookup_keys(F.col("url"))).alias("key"))
        return looked.join(F.broadcast(self.exact) if self.n <= BROADCAST_URLS else self.exact, "key", "left_semi").select("url").distinct()


def listed_urls(urls: DataFrame, listed: DataFrame, url_col: str = "url", max_words: int = MAX_WORDS) -> DataFrame:
    """The distinct urls that are listed; ``listed`` has canonical URLs in its column ``url``."""
    known = Listed(listed, max_words)
    rows = urls.select(F.col(url_col).alias("url"))
    return known.holding(rows.where(known.may_hold(F.col("url"))))


def judge(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, listed, verdict); rules are (block or allow, host/path), and the longest that fits wins over the list."""
    known = Listed(listed)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    maybe = cut(rows.where(known.may_hold(F.col("url"))))
    found = cut(known.holding(maybe))
    hits = join_unique(maybe, found.withColumn("listed", F.lit(True)), ["url"], "left").select("id", "url", F.coalesce("listed", F.lit(False)).alias("listed"))
    rows = rows.where(~known.may_hold(F.col("url"))).withColumn("listed", F.lit(False)).unionByName(hits)
    host, path = host_and_path(F.col("url"))
    rows = rows.select("id", "listed", host.alias("host"), path.alias("path"))
    rule = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is tried first, being outermost
        at = text.index("/")
        site = F.lit(text[:at])
        fits = ((F.col("host") == site) | F.col("host").endswith(F.concat(F.lit("."), site))) & F.col("path").startswith(text[at:])
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rows.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), "listed", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
