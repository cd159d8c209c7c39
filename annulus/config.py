"""Search settings, with the lenient parsing and clamping that callers rely on."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass, replace

# Fixed values.
#: Names that a sharding strategy is known by; anything else means block-id.
PARTITIONS = {
    "block-id": "block-id", "block": "block-id", "block-by-id": "block-id",
    "contiguous-list": "contiguous-list", "contiguous": "contiguous-list", "contiguous-lists": "contiguous-list", "list": "contiguous-list",
    "greedy-list": "greedy-list", "greedy": "greedy-list", "greedy-balanced": "greedy-list", "greedy-lists": "greedy-list", "balanced": "greedy-list",
    "cyclic": "cyclic", "round-robin": "cyclic",
    "random-hash": "random-hash", "random": "random-hash", "hash": "random-hash",
}
#: Flags, and the settings that they set; arguments without a flag are the first three settings, in order.
FLAGS = {"nlist": "nlist", "nprobe": "nprobe", "test": "max_queries", "k": "k", "train": "train", "iters": "iterations", "np": "shards", "partition": "partition", "group": "group", "M": "m", "efc": "ef_construction", "ef": "ef_search"}
PLACES = ("nlist", "nprobe", "max_queries")
#: What a stored index doesn't depend on.
OF_SEARCHES = ("nprobe", "k", "max_queries", "ef_search", "group")


def positive_int(text: str | None, current: int) -> int:
    """The leading integer of ``text``; ``current`` if there is none or it isn't positive."""
    found = re.match(r"\s*[+-]?\d+", text or "")
    return int(found[0]) if found and int(found[0]) > 0 else current


def partition_name(text: str) -> str:
    return PARTITIONS.get(text.strip().lower(), "block-id")


def cache_token(text: str) -> str:
    """``text`` as a part of a path: anything but letters, digits and hyphens becomes a hyphen."""
    return re.sub("[^A-Za-z0-9-]", "-", text) or "none"


@dataclass(frozen=True)
class SearchConfig:
    nlist: int = 16
    nprobe: int = 4
    k: int = 10
    shards: int = 4
    iterations: int = 2
    train: int = 12_000
    partition: str = "block-id"
    m: int = 16
    ef_construction: int = 100
    ef_search: int = 100
    group: str = "none"
    max_queries: int = 2_000

    def clamped(self, n: int) -> SearchConfig:
        """Every setting within its range for ``n`` base vectors."""
        nlist = max(1, min(self.nlist, n))
        k = max(1, self.k)
        return replace(self, nlist=nlist, nprobe=max(1, min(self.nprobe, nlist)), k=k, shards=max(1, self.shards), iterations=max(1, self.iterations), train=max(1, min(self.train, n)), partition=partition_name(self.partition), m=max(1, self.m), ef_construction=max(1, self.ef_construction), ef_search=max(k, self.ef_search), max_queries=max(1, self.max_queries), group=self.group or "manual")

    def merged(self, **texts: str) -> SearchConfig:
        """With settings given as text; those that aren't positive integers keep what they are, unknown ones are ignored."""
        own = asdict(self)
        return replace(self, **{k: positive_int(v, own[k]) if isinstance(own[k], int) else v for k, v in texts.items() if k in own})

    def parsed(self, arguments: Iterable[str]) -> SearchConfig:
        """With settings from a command line: ``--flag=value``, or up to three bare values. Unknown flags are ignored."""
        found, places = self, iter(PLACES)
        for argument in filter(None, arguments):
            if argument.startswith("-"):
                flag, _, value = argument.removeprefix("--").partition("=")
                name = FLAGS.get(flag)
            else:
                name, value = next(places, None), argument
            found = found.merged(**{name: value}) if name else found
        return found

    def digest(self, **more) -> str:
        """Of all settings that an index depends on, and ``more``."""
        return hashlib.sha256(json.dumps({k: v for k, v in asdict(self).items() if k not in OF_SEARCHES} | more, sort_keys=True, default=str).encode()).hexdigest()[:16]
