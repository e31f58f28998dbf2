"""URL filter: allow and block rules in a trie over reversed host labels and path segments.

A rule is a host, ``/`` and a path, like ``example.com/en/``; it fits its host and all subdomains, for urls whose path
starts with the rule's path.  Of the rules that fit a url, the longest wins (code points of host and path); of equally long
ones that with the longer host; a rule given as both allow and block counts as block.

The trie is broadcast while its pickled size is under ``max_broadcast_bytes``; a larger rule set is joined instead
(:func:`filter_by_join`), with the same results.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str]  # (verdict, host/path)

END = ""  # key of a host node's path trie; host labels in a trie may be empty only inside a host, see _labels


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): between the first ``://`` and the first ``/ ? #``; then up to ``?`` or ``#``. Else both empty."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    stop = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:stop]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_ASCII_LOWER), path


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ASCII_LOWER = str.maketrans(UPPER, UPPER.lower())


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate(_ASCII_LOWER), slash + path


def _labels(host: str) -> list[str]:
    return host.split(".")[::-1]


class Node:
    """One host label: children by label, and a path trie of the rules that end here."""

    __slots__ = ("below", "paths")

    def __init__(self) -> None:
        self.below: dict[str, Node] = {}
        self.paths: PathNode | None = None


class PathNode:
    """One path segment: children by whole segment, and rules that end inside the next segment, by its start."""

    __slots__ = ("below", "ends")

    def __init__(self) -> None:
        self.below: dict[str, PathNode] = {}
        self.ends: dict[str, tuple[str, str]] = {}


def build_trie(rules: Iterable[Rule]) -> Node:
    root = Node()
    for verdict, rule in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"a rule's verdict is allow or block, not {verdict!r}")
        host, path = split_rule(rule)
        node = root
        for label in _labels(host) if host else []:
            node = node.below.setdefault(label, Node())
        node.paths = at = node.paths or PathNode()
        *whole, last = path.split("/")
        for segment in whole:
            at = at.below.setdefault(segment, PathNode())
        if at.ends.get(last, ("",))[0] != "block":
            at.ends[last] = (verdict, rule)
    return root


def _longest_path(at: PathNode, segments: list[str]) -> tuple[str, str] | None:
    best = None
    for segment in segments:
        fits = max((e for e in at.ends if segment.startswith(e)), key=len, default=None)
        best = best if fits is None else at.ends[fits]  # deeper segments are longer paths
        at = at.below.get(segment)
        if at is None:
            break
    return best


def look_up(trie: Node, host: str, path: str) -> tuple[str, str] | None:
    """(verdict, rule) of the longest rule that fits, or None."""
    best, longest, node, segments = None, 0, trie, path.split("/")
    for label in [None, *_labels(host)]:
        if label is not None:
            node = node.below.get(label)
        if node is None:
            break
        # Hosts get longer on the way down, so of equally long rules the last has the longest host.
        if node.paths is not None and (found := _longest_path(node.paths, segments)) and len(found[1]) >= longest:
            best, longest = found, len(found[1])
    return best


def filter_urls(pages: DataFrame, rules: Iterable[Rule], *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``id, host, path, rule, verdict`` for every row; ``default`` is the verdict where no rule fits.

    A null url, or one without ``://``, has empty host and path, which only a rule of an empty host and path fits.
    Repeated rows are judged each; an empty table gives an empty result; other columns are not read.
    """
    rules = list(rules)
    trie = build_trie(rules)
    blob = pickle.dumps(trie)
    if len(blob) > max_broadcast_bytes:
        frame = pages.sparkSession.createDataFrame(rules, "verdict string, rule string")
        return filter_by_join(pages, frame, id_col=id_col, url_col=url_col, default=default)
    shared = pages.sparkSession.sparkContext.broadcast(blob)
    out = pages.select(F.col(id_col), F.col(url_col).alias("url"))
    id_type = out.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for batch in batches:
            hosts, paths, found, verdicts = [], [], [], []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                verdict, rule = look_up(own, host, path) or (default, None)
                hosts.append(host), paths.append(path), found.append(rule), verdicts.append(verdict)
            columns = [pa.array(x, pa.string()) for x in (hosts, paths, found, verdicts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "host", "path", "rule", "verdict"])

    return out.mapInArrow(judge, f"`{id_col}` {id_type}, host string, path string, rule string, verdict string")


def filter_by_join(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """As :func:`filter_urls`, for a rule table ``verdict, rule`` of any size: no broadcast, one equi-join.

    Each distinct (host, path) meets the rules on keys made of a host suffix and a path up to one of its slashes; what a
    rule has behind its last slash is compared after the join.
    """
    url = F.col(url_col)
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.regexp_extract(F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)"), r"^[^?#]*", 0))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/]*", 0), UPPER, UPPER.lower()), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/]*((?s:.*))$", 1), F.lit(""))
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    distinct = urls.select("host", "path").distinct()
    labels, segments = F.split("host", r"\.", -1), F.split("path", "/", -1)
    suffixes = F.transform(F.sequence(F.lit(0), F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    starts = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda n: F.array_join(F.slice(segments, 1, n - 1), "/"))
    keyed = distinct.withColumn("k_host", F.explode(F.array_distinct(suffixes))).withColumn("k_path", F.explode(F.array_distinct(starts)))
    rule_path = F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)")
    ruled = rules.where("verdict is not null and rule is not null").select("verdict", "rule", F.translate(F.substring_index("rule", "/", 1), UPPER, UPPER.lower()).alias("k_host"), rule_path.alias("r_path"))
    ruled = ruled.withColumn("k_path", F.regexp_extract("r_path", r"^((?s:.*))/[^/]*$", 1))
    met = keyed.join(ruled, ["k_host", "k_path"]).where(F.startswith("path", "r_path"))
    order = F.struct(F.length("k_host") + F.length("r_path"), F.length("k_host"), F.col("verdict") == "block", "rule", "verdict")
    best = met.groupBy("host", "path").agg(F.max(order).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
