"""Boosted regression trees over blocks of binned rows: a task passes on sums by bin, never rows."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a feature's values, the code of a null, codes in all, rows of a block, rounds after which blocks are kept with new residuals, and
#: values that stand for a block's or a task's where quantiles are sought.
BINS, NULL, CODES, BLOCK, KEEP, POINTS = 32, 32, 33, 1 << 16, 4, 1024
#: Rows that are counted at a time, steps of their residuals, and what a row weighs beside its step: the rows of a bin and the sum of their
#: steps are one double, at most CHUNK * (ROW + STEPS), which is exact below 2**53.
CHUNK, STEPS, ROW = 1 << 14, 2.0**24 - 1, 2.0**38
#: Blocks lie in memory as they are sent to a task's Python, since every pass sends all of them; what does not fit goes to disk.
KEPT = StorageLevel(True, True, False, True)
#: Fits that run side by side.
FITS = 4


def evenly(points: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, POINTS) values at even steps of the weight of (feature, any number) values, and the weight of each."""
    order = points.argsort(axis=1, kind="stable")
    grown = np.take_along_axis(np.broadcast_to(weights, points.shape), order, axis=1).cumsum(axis=1)
    steps = (np.arange(POINTS) + 0.5) / POINTS * weights.sum()
    at = np.stack([np.searchsorted(g, steps).clip(max=len(g) - 1) for g in grown])
    return np.take_along_axis(np.take_along_axis(points, order, axis=1), at, axis=1), np.full(POINTS, weights.sum() / POINTS)


def plain(batch, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) values of an Arrow batch, null as 0, and which are null."""
    gone = np.stack([batch.column(f).is_null().to_numpy(zero_copy_only=False) for f in features])
    return np.stack([batch.column(f).fill_null(0.0).to_numpy(zero_copy_only=False) for f in features]), gone


def thresholds(rows: DataFrame, features: list[str], ends: list[int]) -> list[list[np.ndarray]]:
    """For each end and feature, null as 0, the distinct values at its 31 quantiles over the rows of i below the end. All rows are read,
    once: a block gives POINTS of its ordered values, a task POINTS of its blocks', so ranks are off by some thousandths and a task returns
    a small table for each end."""

    def run(batches):
        held, points = [[] for _ in ends], [[] for _ in ends]

        def close(k):
            x = np.sort(np.concatenate(held[k], axis=1), axis=1)
            n = x.shape[1]
            points[k].append((x[:, ((np.arange(POINTS) + 0.5) / POINTS * n).astype(int)], np.full(POINTS, n / POINTS)))
            held[k].clear()

        for batch in batches:
            x, i = plain(batch, features)[0], batch.column("i").to_numpy()
            for k, end in enumerate(ends):
                if (i < end).any():
                    held[k].append(x[:, i < end])
                    if sum(part.shape[1] for part in held[k]) >= BLOCK:
                        close(k)
        for k in range(len(ends)):
            if held[k]:
                close(k)
            if points[k]:
                at, each = evenly(np.concatenate([p[0] for p in points[k]], axis=1), np.concatenate([p[1] for p in points[k]]))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([each.tobytes()], pa.binary())], names=["fit", "points", "weights"])

    columns = rows.where(F.col("i") < max(ends)).select("i", *features)
    parts = columns.mapInArrow(run, "fit int, points binary, weights binary").collect()  # a small table for each task and end
    found = []
    for k in range(len(ends)):
        own = [r for r in parts if r.fit == k]
        at = np.concatenate([np.frombuffer(r.points).reshape(len(features), -1) for r in own], axis=1)
        at = evenly(at, np.concatenate([np.frombuffer(r.weights) for r in own]))[0]
        found.append([np.unique(v[np.arange(1, BINS) * POINTS // BINS]) for v in at])
    return found


def binned(x: np.ndarray, gone: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """(feature, row) codes: how many thresholds lie below the value, NULL for null."""
    out = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x, strict=True)]).astype(np.uint8)
    out[gone] = NULL
    return out


def paired(codes: np.ndarray) -> np.ndarray:
    """(pair, row): the codes of features 2k and 2k + 1 as one number, six bits each; the partner of a last one without any is 0."""
    out = codes[::2].astype(np.uint16) << np.uint16(6)
    out[: len(codes) // 2] |= codes[1::2]
    return out


def code_of(codes: np.ndarray, f: int) -> np.ndarray:
    """The codes of a feature among paired ones."""
    return codes[f // 2] & np.uint16(63) if f % 2 else codes[f // 2] >> np.uint16(6)


def to_blocks(rows: DataFrame, features: list[str], target: str, cuts: list[list[np.ndarray]], spans: list[tuple[int, int]]) -> list[RDD]:
    """For each fit (codes by pairs, rest, key, valid) of some BLOCK rows each, dealt evenly: the rows of i below the span's end, valid from its
    middle on. rows: (key, i, target, feature...), binned in one pass for all fits; rest: the target."""

    def run(batches):
        held: dict = {}
        sent: dict = {}

        def packed(kind):
            found = held.pop(kind)
            place = sent[kind] = (sent.get(kind, TaskContext.get().partitionId()) + 1) % n
            data = [np.concatenate([p[k] for p in found], axis=-1).tobytes() for k in range(3)]
            return pa.RecordBatch.from_arrays([pa.array([kind[0]], pa.int32()), pa.array([kind[1]]), pa.array([place], pa.int32()), *[pa.array([d], pa.binary()) for d in data]], names=["fit", "valid", "place", "codes", "rest", "key"])

        for batch in batches:
            (x, gone), i = plain(batch, features), batch.column("i").to_numpy()
            rest, key = batch.column("rest").to_numpy(), batch.column("key").to_numpy().astype(np.uint32)
            for k, (middle, end) in enumerate(spans):
                for valid, own in ((False, i < middle), (True, (i >= middle) & (i < end))):
                    if own.any():
                        held.setdefault((k, valid), []).append((paired(binned(x[:, own], gone[:, own], cuts[k])), rest[own], key[own]))
                        if sum(len(p[1]) for p in held[k, valid]) >= BLOCK:
                            yield packed((k, valid))
        for kind in [*held]:
            yield packed(kind)

    n, pairs = rows.sparkSession.sparkContext.defaultParallelism, (len(features) + 1) // 2
    columns = rows.where(F.col("i") < max(end for _, end in spans)).select("key", "i", F.col(target).cast("double").alias("rest"), *features)
    packs = columns.mapInArrow(run, "fit int, valid boolean, place int, codes binary, rest binary, key binary")
    dealt = packs.rdd.map(lambda r: (r.place, tuple(r))).partitionBy(n, int)
    read = lambda r: (np.frombuffer(r[3], dtype=np.uint16).reshape(pairs, -1), np.frombuffer(r[4], dtype=float), np.frombuffer(r[5], dtype=np.uint32), r[1])
    return [dealt.values().filter(lambda r, k=k: r[0] == k).map(read) for k in range(len(spans))]


def drawn(key: np.ndarray, turn: int, share: float) -> np.ndarray:
    """Which rows a round learns from: a share of them by a hash of the row's key and the round, wherever the row lies."""
    x = key ^ np.uint32(turn * 0x9E3779B9 & 0xFFFFFFFF)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return (x ^ (x >> np.uint32(16))) < share * 2.0**32


def places(codes: np.ndarray, levels: list[dict[int, tuple]]) -> np.ndarray:
    """The node of each row after some levels, numbered as in a heap from 1; rows of a node that is not split go to the left. A level's
    splits: {node: (feature, last code on the left, whether null is on the left)}."""
    at = np.ones(codes.shape[1], dtype=np.uint8)
    for splits in levels:
        right = np.zeros(len(at), dtype=bool)
        for node, (f, last, null) in splits.items():
            code = code_of(codes, f)
            away = code > last
            if null:
                away &= code != NULL
            right |= away & (at == node)
        at = (at << np.uint8(1)) | right
    return at


def values(codes: np.ndarray, tree: tuple) -> np.ndarray:
    levels, leaves = tree
    return leaves[places(codes, levels)]


def weighed(rest: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(weight, low, unit): a row that is kept weighs ROW and the steps of its residual above the least one, any other nothing."""
    low = rest.min()
    unit = (rest.max() - low) / STEPS or 1.0
    return np.where(keep, ROW + np.rint((rest - low) / unit), 0.0), low, unit


def by_code(codes: np.ndarray, weight: np.ndarray, low: float, unit: float, width: int) -> np.ndarray:
    """(feature, code, (rows, sum of rest)) of weighed rows: one count for each two features, whose margins are those of either."""
    pairs = np.stack([np.bincount(c, weights=weight, minlength=CODES << 6) for c in codes]).reshape(-1, CODES, 64)[..., :CODES]
    each = np.stack([pairs.sum(axis=2), pairs.sum(axis=1)], axis=1).reshape(-1, CODES)[:width]
    n = np.floor(each / ROW)
    return np.stack([n, (each - n * ROW) * unit + n * low], axis=-1)


def sums_of(blocks: RDD, width: int, trees: list, levels: list, nodes: list[int], turn: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(node, feature, code, (rows, sum of rest)) of a round's rows at some nodes, after further trees; and at the root
    (squares, rows) of the rows held back."""

    def run(part):
        total, error = np.zeros((len(nodes), width, CODES, 2)), np.zeros(2)
        for block, left, key, valid in part:
            if valid and levels:
                continue
            for start in range(0, len(left), CHUNK):
                own = slice(start, start + CHUNK)
                codes, rest = block[:, own], left[own]
                for tree in trees:
                    rest = rest - values(codes, tree)
                if valid:
                    error += rest @ rest, len(rest)
                    continue
                weight, low, unit = weighed(rest, drawn(key[own], turn, share))
                if not levels:
                    total[0] += by_code(codes, weight, low, unit, width)
                    continue
                at = places(codes, levels)
                for j, node in enumerate(nodes):
                    here = np.flatnonzero((at == node) & (weight > 0))
                    total[j] += by_code(codes[:, here], weight[here], low, unit, width)
        yield total, error

    parts = blocks.mapPartitions(run).collect()  # a small table for each task
    return sum(p[0] for p in parts), sum(p[1] for p in parts)


def best_split(hist: np.ndarray, zero: np.ndarray, chosen: np.ndarray, least: int) -> tuple | None:
    """(feature, last code, null left, gain, index, (rows, sum) left, (rows, sum) right) of the split of one node that takes most squares
    away. hist: (feature, code, 2). Of `width` features index k is the value, null as 0, and width + k whether it is null."""
    width = len(hist)
    known = hist[:, :NULL].copy()
    known[np.arange(width), zero] += hist[:, NULL]
    value = known.cumsum(axis=1)[:, :-1]
    lefts = np.concatenate([value, np.broadcast_to((hist[:, :NULL].sum(axis=1))[:, None], value.shape)])
    total = hist[0].sum(axis=0)
    rights = total - lefts
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = lefts[..., 1] ** 2 / lefts[..., 0] + rights[..., 1] ** 2 / rights[..., 0] - total[1] ** 2 / total[0]
    ok = (lefts[..., 0] >= least) & (rights[..., 0] >= least) & chosen[:, None]
    gain = np.where(ok, gain, -np.inf)
    k, b = np.unravel_index(int(gain.argmax()), gain.shape)
    if not gain[k, b] > 1e-12 * abs(total[1] ** 2 / max(total[0], 1)):
        return None
    f = int(k % width)
    rule = (f, int(b), bool(zero[f] <= b)) if k < width else (f, NULL - 1, False)
    return (*rule, float(gain[k, b]), int(k), lefts[k, b], rights[k, b])


def grow(blocks: RDD, width: int, trees: list, turn: int, zero: np.ndarray, rng, depth: int, least: int, sample: float, root: np.ndarray, scale: float) -> tuple[tuple, dict[int, float]]:
    """A round's tree (splits by level, value by node) and the gain of each feature. Of two children the smaller is counted, the other
    is what is left of its parent."""
    pick = lambda: np.isin(np.arange(2 * width), rng.choice(2 * width, int(np.ceil(sample * 2 * width)), replace=False))
    hists, levels, gains = {1: root}, [], {}
    leaves = np.zeros(2 ** (depth + 1))
    total = root[0].sum(axis=0)
    leaves[1] = total[1] / max(total[0], 1)
    for level in range(depth):
        found = {n: s for n in sorted(hists) if (s := best_split(hists[n], zero, pick(), least))}
        if not found:
            break
        levels.append({n: s[:3] for n, s in found.items()})
        for n in range(2**level, 2 ** (level + 1)):
            leaves[2 * n] = leaves[2 * n + 1] = leaves[n]
        for n, s in found.items():
            gains[s[4]] = gains.get(s[4], 0.0) + scale**2 * s[3]
            leaves[2 * n], leaves[2 * n + 1] = s[5][1] / s[5][0], s[6][1] / s[6][0]
        if level == depth - 1:
            break
        small = {n: 2 * n + int(s[6][0] < s[5][0]) for n, s in found.items()}
        counted = sums_of(blocks, width, trees, levels, list(small.values()), turn, sample)[0]
        parents, hists = hists, {}
        for j, (n, child) in enumerate(small.items()):
            hists[child], hists[child ^ 1] = counted[j], parents[n] - counted[j]
    return (levels, scale * leaves), gains


def boost(train: DataFrame, features: list[str], target: str, depth: int, rounds: int, step: float, sample: float, least: int, seed: int) -> tuple[list[np.ndarray], list, np.ndarray]:
    """boost_each for one table (key, valid, target, feature...)."""
    rows = train.select("key", F.col("valid").cast("int").alias("i"), target, *features)
    return boost_each(rows, features, target, [(1, 2)], depth, rounds, step, sample, least, seed)[0]


def boost_each(rows: DataFrame, features: list[str], target: str, spans: list[tuple[int, int]], depth: int, rounds: int, step: float, sample: float, least: int, seed: int) -> list[tuple[list[np.ndarray], list, np.ndarray]]:
    """For each span (thresholds, trees, importances) of squared loss over the rows of i below its end: the first tree fits the target, each
    further one twice the residual, by `step`; a round learns from a share `sample` of rows and each node from as large a share of features;
    rounds end when the error of the rows held back, those from the span's middle on, rises. Feature k is the value, null as 0, width + k
    whether it is null. rows: (key, i, target, feature...).

    All rows are read twice, whatever the number of spans: for thresholds, and to be binned for each fit, to two bytes for two features, and
    kept in its blocks. Up to FITS fits are submitted side by side. Each level of a tree is one pass, from which only sums by node, feature
    and bin return, so tasks and driver hold the same however many rows there are. Blocks are kept with new residuals every KEEP rounds.
    """
    rows = rows.select("key", F.col("i").cast("int").alias("i"), target, *[F.col(f).cast("double").alias(f) for f in features])
    cuts = thresholds(rows, features, [middle for middle, _ in spans])
    blocks = to_blocks(rows, features, target, cuts, spans)
    with ThreadPoolExecutor(FITS) as pool:
        return list(pool.map(lambda own: (own[0], *grown(own[1], own[0], depth, rounds, step, sample, least, seed)), zip(cuts, blocks, strict=True)))


def grown(blocks: RDD, cuts: list[np.ndarray], depth: int, rounds: int, step: float, sample: float, least: int, seed: int) -> tuple[list, np.ndarray]:
    """The trees and importances of one fit."""
    width, zero = len(cuts), np.array([np.searchsorted(c, 0.0) for c in cuts])
    blocks = blocks.persist(KEPT)
    rng = np.random.default_rng(seed)
    trees, gains, late, best, least_error, old = [], [], [], 0, np.inf, None
    for turn in range(rounds + 1):
        root, error = sums_of(blocks, width, late, [], [1], turn, sample)
        if old is not None:
            old.unpersist()
            old = None
        if turn:
            now = error[0] / error[1]
            if now > least_error:
                break
            if now < least_error:
                best, least_error = turn, now
        if turn == rounds:
            break
        tree, gain = grow(blocks, width, late, turn, zero, rng, depth, least, sample, root[0], 2.0 if turn else 1.0)
        tree = (tree[0], (step if turn else 1.0) * tree[1])
        trees.append(tree)
        gains.append(gain)
        late.append(tree)
        if len(late) == KEEP:
            old, done = blocks, late
            blocks = old.map(lambda b, done=tuple(done): (b[0], b[1] - sum(values(b[0], t) for t in done), b[2], b[3])).persist(KEPT)
            late = []
    blocks.unpersist()
    weight = np.zeros(2 * width)
    for gain in gains[:best]:
        for k, g in gain.items():
            weight[k] += g
    return trees[:best], weight / weight.sum() if weight.sum() > 0 else weight


def predicted(rows: DataFrame, features: list[str], cuts: list[np.ndarray], trees: list, keys: list[str]) -> DataFrame:
    """(keys..., pred) of trees."""
    columns = rows.select(*keys, *[F.col(f).cast("double").alias(f"_{f}") for f in features])
    names = [f"_{f}" for f in features]
    shared = rows.sparkSession.sparkContext.broadcast((cuts, trees))

    def run(batches):
        cuts, trees = shared.value
        for batch in batches:
            codes = paired(binned(*plain(batch, names), cuts))
            pred = np.zeros(batch.num_rows)
            for tree in trees:
                pred += values(codes, tree)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], pa.array(pred)], names=[*keys, "pred"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema if f.name in keys)
    return columns.mapInArrow(run, fields + ", pred double")
