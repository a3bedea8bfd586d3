"""URL filter over a sorted array of digests.

Rules and blocked hosts are kept in one file: 64-bit xxhash keys in ascending order, then the
offsets of their full strings, then the strings. Spark hands the file to every executor; tasks
memory-map it, look up all of a batch's candidate keys in one binary search, and compare the full
string wherever a key is met, so a collision of keys never decides.

A rule is a host and a path. It fits its host and all subdomains where the URL's path starts with
the rule's; the longest that fits decides. Else a URL is blocked if its host or a domain above it is
in the list of blocked hosts.

Defined results: a null URL or one without "://" has an empty host and path and no rule, and is
allowed; repeated rows are judged alike; an empty table gives an empty result; other columns are
passed on as they are, but one named like the output, which is replaced.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALLOW, BLOCK, HOST = 0, 1, 2
#: Built on the driver, so a list has a bound.
MAX_ENTRIES = 50_000_000
HEAD = struct.Struct("<8sQQ")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def build_index(rules: Iterable[Rule], blocked_hosts: Iterable[str]) -> bytes:
    """The file's bytes. Entries: kind byte and string; keys hash the string alone."""
    entries = [(bytes([BLOCK if r.verdict == "block" else ALLOW]), r.text.encode()) for r in rules]
    entries += [(bytes([HOST]), h.encode()) for h in blocked_hosts]
    if len(entries) > MAX_ENTRIES:
        raise ValueError(f"{len(entries)} entries; the bound is {MAX_ENTRIES}")
    # hosts hold no "/", rules do: their strings never meet
    entries = sorted((xxhash.xxh64_intdigest(s), s, k) for k, s in set(entries))
    texts = [k + s for _, s, k in entries]
    ends = np.cumsum([0, *map(len, texts)]).astype("<u8")
    keys = np.array([e[0] for e in entries], "<u8")
    return HEAD.pack(b"URLIDX01", len(entries), ends[-1]) + keys.tobytes() + ends.tobytes() + b"".join(texts)


class DigestArray:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            magic, n, size = HEAD.unpack(f.read(HEAD.size))
        if magic != b"URLIDX01":
            raise ValueError("not an index of URLs")
        part = lambda kind, at, k: np.memmap(path, kind, "r", at, (k,)) if k else np.zeros(0, kind)
        self.keys = part("<u8", HEAD.size, n)
        self.ends = part("<u8", HEAD.size + 8 * n, n + 1)
        self.texts = part("u1", HEAD.size + 16 * n + 8, size)

    def find(self, candidates: list[bytes]) -> list[int | None]:
        """The kind of each string that is in the array, else None."""
        if not candidates:
            return []
        hashed = np.array([xxhash.xxh64_intdigest(c) for c in candidates], "<u8")
        at = np.searchsorted(self.keys, hashed)
        out: list[int | None] = [None] * len(candidates)
        met = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == hashed) if len(self.keys) else []
        for i in met:
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == hashed[i]:
                text = self.texts[int(self.ends[k]) : int(self.ends[k + 1])].tobytes()
                if text[1:] == candidates[i]:
                    out[i] = text[0]
                    break
                k += 1
        return out


@lru_cache(maxsize=4)
def _opened(path: str) -> DigestArray:
    return DigestArray(path)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def domains(host: str) -> list[str]:
    """The host and the domains above it."""
    out, at = [host] if host else [], host.find(".")
    while at >= 0:
        out.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return out


JUDGED = "host string, path string, rule string, verdict string"


def judge(index: DigestArray, urls: Iterable[str | None], path_lengths: list[int]) -> list[tuple]:
    """(host, path, rule, verdict) of each URL; path_lengths: those that rules have."""
    split = [split_url(u) for u in urls]
    names = {h: domains(h) for h, _ in split}
    wanted = {d + p[:n] for h, p in split for d in names[h] for n in path_lengths if n <= len(p)}
    wanted = [*wanted.union(*names.values())]
    kinds = dict(zip(wanted, index.find([w.encode() for w in wanted]), strict=True))
    out = []
    for h, p in split:
        fits = [(len(d) + n, len(d), d + p[:n]) for d in names[h] for n in path_lengths if n <= len(p) and kinds[d + p[:n]] in (ALLOW, BLOCK)]
        rule = max(fits)[2] if fits else None
        blocked = kinds[rule] == BLOCK if rule else any(kinds[d] == HOST for d in names[h])
        out.append((h, p, rule, "block" if blocked else "allow"))
    return out


def filtered(pages: DataFrame, rules: list[Rule], blocked_hosts: list[str], url: str = "url") -> DataFrame:
    """The rows with a struct ``url_filter`` of host, path, rule and verdict."""
    spark: SparkSession = pages.sparkSession
    data = build_index(rules, blocked_hosts)
    name = f"url-index-{hashlib.sha256(data).hexdigest()[:20]}.bin"
    # the same content goes by the same path, which Spark takes up once
    folder = os.path.join(tempfile.gettempdir(), f"url-index-{spark.sparkContext.applicationId}")
    os.makedirs(folder, exist_ok=True)
    made = os.path.join(folder, name)
    with open(made, "wb") as f:
        f.write(data)
    spark.sparkContext.addFile(made)
    lengths = sorted({len(r.path) for r in rules})

    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = _opened(SparkFiles.get(name))
        for urls in batches:
            yield pd.DataFrame(judge(index, urls, lengths), columns=["host", "path", "rule", "verdict"])

    return pages.withColumn("url_filter", F.pandas_udf(judged, JUDGED)(F.col(url)))
