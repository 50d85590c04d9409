"""Filling fixed-capacity containers with items: cost-balanced packing.

An item's cost is linear in its tokens plus quadratic for attention. Items go, in descending size, to the
container of lowest cost that has room for them. Items are spread by a salt over groups of about GROUP_TOKENS
tokens, each packed by one task: a group's size is bounded, its item sizes are those of the corpus, and the
groups' unfilled last containers cost about one container in GROUP_TOKENS / capacity.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.runtime import cut

CAPACITY = 2_048
#: Tokens of a group that one task packs (2,048 containers of the usual capacity).
GROUP_TOKENS = 4_194_304
LINEAR = 1.0
#: Attention's cost per token pair; at the capacity both parts are equal.
QUADRATIC = 1.0 / CAPACITY


def pack(sizes: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    """Container number of each item (none larger than the capacity); equal sizes keep their order.

    Starts with as many containers as the tokens need; where no open one has room, another is opened. Those
    without room for the size at hand wait, by room, until the sizes have come down to them.
    """
    order = np.argsort(-sizes, kind="stable")
    need = max(1, -(-int(sizes.sum()) // capacity))
    room = [capacity] * need
    open_ = [(0.0, i) for i in range(need)]
    waiting: list[tuple[int, float, int]] = []
    out = np.empty(len(sizes), dtype=np.int64)
    for i, n in zip(order.tolist(), sizes[order].tolist()):
        while waiting and -waiting[0][0] >= n:
            _, c, b = heapq.heappop(waiting)
            heapq.heappush(open_, (c, b))
        while open_ and room[open_[0][1]] < n:
            c, b = heapq.heappop(open_)
            heapq.heappush(waiting, (-room[b], c, b))
        if open_:
            c, b = open_[0]
        else:
            c, b = 0.0, len(room)
            room.append(capacity)
            heapq.heappush(open_, (c, b))
        room[b] -= n
        heapq.heapreplace(open_, (c + linear * n + quadratic * n * n, b))
        out[i] = b
    # containers that got nothing are left out of the numbering
    used = np.unique(out)
    return np.searchsorted(used, out)


def _pack_group(capacity: int, linear: float, quadratic: float) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "piece"], kind="stable")
        box = pack(pdf["n"].to_numpy(), capacity, linear, quadratic)
        return pdf.assign(container=pdf["grp"].to_numpy() * (1 << 32) + box)[["id", "piece", "start", "n", "container"]]

    return run


def assign_containers(sizes: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """(id_col, piece, start_token, n_tokens, container): every item, or every piece of it, in a container.

    Only an item larger than the capacity is split: into full pieces, each of which fills a container, and a rest that
    is packed like an item; the pieces of a giant item are spread over the groups too. Items without tokens, null sizes included, are packed with n_tokens 0. Container numbers
    are unique over the corpus and the same on every run for the same ids and sizes.
    """
    cap = F.lit(capacity)
    n = F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("bigint")
    items = sizes.select(F.col(id_col).alias("id"), n.alias("size"))
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), cap.cast("bigint"))
    pieces = items.select("id", "size", F.posexplode(starts).alias("piece", "start")).select("id", "piece", "start", F.least(F.col("size") - F.col("start"), cap).alias("n"))
    pieces = cut(pieces)
    tokens = pieces.agg(F.sum(F.col("n") + 1)).first()[0] or 0
    groups = max(1, -(-int(tokens) // group_tokens))
    salted = pieces.withColumn("grp", F.pmod(F.xxhash64("id", "piece"), F.lit(groups)))
    packed = salted.groupBy("grp").applyInPandas(_pack_group(capacity, linear, quadratic), "id bigint, piece int, start bigint, n bigint, container bigint")
    return packed.toDF(id_col, "piece", "start_token", "n_tokens", "container")
