"""Allow and block lists of URLs in a trie over reversed host labels and path segments."""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayspark.session import durable

# Entries that are broadcast as one trie, some 500 bytes each; more are matched block by block.
MAX_RULES = 500_000
FOUND = "size int, host_size int, blocks boolean, rule string"


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = ""

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass
class Node:
    """A host label or a whole path segment.

    ``paths`` is the root of the paths of the host that ends here.  ``ends`` has the rules whose path ends
    in this place, by the beginning of the next segment that they ask for.
    """

    children: dict[str, Node] = field(default_factory=dict)
    paths: Node | None = None
    ends: dict[str, Rule] = field(default_factory=dict)
    longest: int = 0

    def child(self, name: str) -> Node:
        return self.children.setdefault(name, Node())


class Trie:
    """Finds the longest rule that fits: by the characters of host and path, then by those of the host.

    Of an allow and a block rule for the same host and path, the block rule counts.
    """

    def __init__(self, rules: Sequence[Rule]):
        self.root = Node()
        for rule in rules:
            if rule.verdict not in ("allow", "block"):
                raise ValueError(f"no such verdict: {rule.verdict}")
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.child(label)
            node.paths = node.paths or Node()
            *whole, beginning = rule.path.split("/")
            at = node.paths
            for segment in whole:
                at = at.child(segment)
            known = at.ends.get(beginning)
            if known is None or rule.verdict == "block":
                at.ends[beginning] = rule
            at.longest = max(at.longest, len(beginning))

    def hosts(self, host: str) -> list[Node]:
        """The path tries of the host and all its parent domains, the shortest domain first."""
        found, node = [], self.root
        for label in reversed(host.split(".")):
            node = node.children.get(label)
            if node is None:
                break
            if node.paths is not None:
                found.append(node.paths)
        return found

    @staticmethod
    def fit(tries: list[Node], path: str) -> Rule | None:
        best, most = None, (-1, -1)
        segments = path.split("/")
        for node in tries:
            at: Node | None = node
            for segment in segments:
                for n in range(min(at.longest, len(segment)) + 1):
                    rule = at.ends.get(segment[:n])
                    if rule is not None and (size := (len(rule.text), len(rule.host))) > most:
                        best, most = rule, size
                at = at.children.get(segment)
                if at is None:
                    break
        return best


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first ``://``, A-Z lower-cased, and the path; both empty without one."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    pattern = "://([^/?#]*)([^?#]*)"
    host = F.regexp_extract(text, pattern, 1)
    lower = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return lower, F.regexp_extract(text, pattern, 2)


def judge(spark: SparkSession, rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """The longest of at most ``MAX_RULES`` rules that fits, as a struct that is larger for a rule that counts before
    another; null where none fits."""
    shared = spark.sparkContext.broadcast(Trie(rules))

    def look_up(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        trie = shared.value
        codes = hosts.dictionary_encode()
        tries = [trie.hosts(h) for h in codes.dictionary.to_pylist()]
        found = [
            trie.fit(tries[h], p)
            for h, p in zip(codes.indices.to_pylist(), paths.to_pylist(), strict=True)
        ]
        columns = [
            pa.array([r and len(r.text) for r in found], pa.int32()),
            pa.array([r and len(r.host) for r in found], pa.int32()),
            pa.array([r and r.verdict == "block" for r in found], pa.bool_()),
            pa.array([r and r.text for r in found], pa.string()),
        ]
        names = [c.split()[0] for c in FOUND.split(", ")]
        return pa.StructArray.from_arrays(columns, names, mask=pa.array([r is None for r in found]))

    look_up.__annotations__ = {"hosts": pa.Array, "paths": pa.Array, "return": pa.Array}
    return F.arrow_udf(look_up, FOUND)(host, path)


def judge_pages(pages: DataFrame, rules: Sequence[Rule], otherwise: str = "allow") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` for every row of ``pages``.

    Where no rule fits, ``rule`` is null and the verdict is ``otherwise``; so for a null or odd URL.  Rules beyond
    ``MAX_RULES`` are matched in several passes over hosts and paths, each with a trie of that many.
    Repeated rows are judged alike; an empty table gives no rows; other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    blocks = [rules[i : i + MAX_RULES] for i in range(0, len(rules), MAX_RULES)] or [[]]
    found = split
    for n, block in enumerate(blocks):
        best = judge(pages.sparkSession, block, F.col("host"), F.col("path"))
        if n:
            # Stored, so that no worker holds two tries at a time.
            found = durable(found).withColumn("next", best).withColumn("found", F.greatest("found", "next")).drop("next")
        else:
            found = found.withColumn("found", best)
    verdict = F.when(F.col("found.blocks"), "block").when(F.col("found").isNotNull(), "allow").otherwise(otherwise)
    return found.select("page_id", "host", "path", "found.rule", verdict.alias("verdict"))
