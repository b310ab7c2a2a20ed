"""URL rules as a sort-merge range join.

A host is turned round into a key whose labels each end in a dot (`a.example.com` becomes
`com.example.a.`), so that the hosts under a rule's host are exactly the keys from the rule's key
up to the same key with its last dot raised by one. Keys and rules are dealt by range; within a
range one sorted sweep keeps a stack of the rules whose host interval is open. Intervals of hosts
nest or are apart, so the stack holds one entry a label at most. The paths of a host's rules are prefixes, so they are nested
intervals too: they are kept in order, each with the longest other that it lies in, and a url's path finds the innermost by
bisection and a walk outwards. The longest rule text wins, and the smaller text among equals.

Ranges are cut on (key, path, row) at fences drawn from a bounded sample of the urls (the sample only
places the cuts, every url is judged), so a host or a url that holds a third of all rows is spread over many
ranges. A fence holds at most FENCE characters of a key and of a path. A rule is copied to each range that its interval meets.

Defined cases: a null url or one without `://` has an empty host and path and fits no rule; hosts
are taken literally (port and user info included) and urls whole, however long; repeated rows are judged each; of equal rules with
several verdicts the smallest verdict counts; an empty table
gives an empty result; no rules give the default verdict everywhere. Ids are cast to long.
"""

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AFTER = "/"  # the character that follows "." in byte order
FENCE = 256


def host_and_path(url):
    """Columns host and path of a url column, see the rules above."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def host_key(host: str) -> str:
    return "".join(f"{label}." for label in reversed(host.split(".")))


def split_rule(rule: str) -> tuple[str, str]:
    """(host, path) of a rule such as `example.com/en/`."""
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


class HostRules:
    """The rules of one host, by path."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        best: dict[str, tuple[str, str]] = {}
        for path, rule, verdict in rules:
            if path not in best or (rule, verdict) < best[path]:
                best[path] = (rule, verdict)
        self.paths = sorted(best)
        self.rules = [best[p] for p in self.paths]
        self.outer: list[int] = []  # the longest other path that each one starts with
        open_: list[int] = []
        for k, path in enumerate(self.paths):
            while open_ and not path.startswith(self.paths[open_[-1]]):
                open_.pop()
            self.outer.append(open_[-1] if open_ else -1)
            open_.append(k)

    def longest(self, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest path that `path` starts with."""
        k = bisect_right(self.paths, path) - 1
        while k >= 0 and not path.startswith(self.paths[k]):
            k = self.outer[k]
        return self.rules[k] if k >= 0 else None


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", fences_per_partition: int = 32) -> DataFrame:
    """(id, host, path, rule, verdict) of each page; rules has columns rule and verdict.

    The driver holds a sample of `fences_per_partition` keys for each shuffle partition, never more.
    """
    spark = pages.sparkSession
    n = partitions(spark)
    host, path = host_and_path(F.col(url_col).cast("string"))
    key = F.concat(F.array_join(F.reverse(F.split(F.col("host"), r"\.", -1)), "."), F.lit("."))
    urls = pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path")).withColumn("key", key).withColumn("row", F.monotonically_increasing_id())
    short = urls.select(F.substring("key", 1, FENCE).alias("key"), F.substring("path", 1, FENCE).alias("path"), "row", F.xxhash64("key", "path", "id", "row").alias("h"))
    drawn = sorted((r.key, r.path, r.row) for r in short.orderBy("h").limit(n * fences_per_partition).collect())
    fences = sorted({drawn[i * len(drawn) // n] for i in range(1, n)}) if drawn else []

    def dealt_urls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["pid"] = [bisect_right(fences, (k[:FENCE], p[:FENCE], r)) for k, p, r in zip(b["key"], b["path"], b["row"])]
            b["pid"] = b["pid"].astype("int32")
            yield b.assign(kind=1, rule=None, verdict=None)[["pid", "key", "kind", "path", "id", "host", "rule", "verdict"]]

    def dealt_rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rule, verdict in zip(b["rule"], b["verdict"]):
                rule_host, rule_path = split_rule(rule)
                start = host_key(rule_host)
                # keys from `start` up to `start` with its last dot raised; cut short, they lie between these
                stop = (start[:-1] + AFTER)[:FENCE] if len(start) <= FENCE else start[:FENCE] + "\U0010ffff"
                first, last = bisect_right(fences, (start[:FENCE], "", -1)), bisect_left(fences, (stop, "", -1))
                rows += [(p, start, 0, rule_path, None, rule_host, rule, verdict) for p in range(first, last + 1)]
            out = pd.DataFrame(rows, columns=["pid", "key", "kind", "path", "id", "host", "rule", "verdict"])
            yield out.astype({"pid": "int32", "kind": "int32", "id": "Int64"})

    schema = "pid int, key string, kind int, path string, id long, host string, rule string, verdict string"
    given = rules.where(F.col("rule").isNotNull()).select(F.col("rule").cast("string"), F.coalesce(F.col("verdict").cast("string"), F.lit(default)).alias("verdict"))
    both = urls.select("id", "host", "path", "key", "row").mapInPandas(dealt_urls, schema).unionByName(given.mapInPandas(dealt_rules, schema))

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[list] = []  # [key, rules as they come, HostRules]: each key starts with those below it
        at = None
        for b in batches:
            out = []
            for pid, k, kind, p, i, h, rule, verdict in zip(*(b[c] for c in ("pid", "key", "kind", "path", "id", "host", "rule", "verdict"))):
                if pid != at:
                    stack, at = [], pid
                while stack and not k.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != k:
                        stack.append([k, [], None])
                    stack[-1][1].append((p, rule, verdict))
                    continue
                best = None
                for entry in stack:
                    if entry[2] is None:
                        entry[1:] = [None, HostRules(entry[1])]
                    fit = entry[2].longest(p)
                    if fit and (best is None or (-len(fit[0]), fit[0]) < (-len(best[0]), best[0])):
                        best = fit
                out.append((i, h, p, *(best or (None, default))))
            yield pd.DataFrame(out, columns=["id", "host", "path", "rule", "verdict"]).astype({"id": "Int64"})

    swept = both.repartition(n, "pid").sortWithinPartitions("pid", "key", "kind", "rule").mapInPandas(sweep, "id long, host string, path string, rule string, verdict string")
    return swept.withColumnRenamed("id", id_col)
