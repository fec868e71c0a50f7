"""Near-duplicate embeddings by product quantisation, without losing a link.

Unit vectors are dealt to coarse lists; a list's members carry a code (one nearest
codeword of the residual in each subspace) and their quantisation error.  A vector
probes every list that could hold a partner: a partner within ``r`` lies in list
``a`` only if the vector is within ``r`` of the half-space nearer to ``a`` than to its
own list.  Inside a list, asymmetric table-lookup distances to the coded members drop
pairs that are out of reach even with the member's error added; exact cosines in
double precision settle the rest.  Both tests are lower bounds of the distance, so
probing is sufficient and recall is one.

Coarse lists and codebooks are fitted on at most ``sample`` vectors (those of least
hash); every vector is indexed.  A list of more than ``crowd`` rows is parted again, on the
executors, into lists of its own fitted on as many of its rows, and those again, so that
lists stay about as long however large the table is.  What no parting thins out, a heap of
vectors nearer to each other than the radius, is compared block by block, each task two
blocks of bounded size; a task returns link counts and a spanning set of links, never all
pairs.  Equal vectors of a label collapse into one weighted representative first.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows without a label, link with nothing (n_links 0, own component);
vectors of unequal length never link; rows that repeat an id over different vectors
are one node whose links add up; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, ship
from .components import connected_components

SAMPLE = 16_384
#: Coarse lists: one for so many vectors, within bounds that hold at each level.
ROWS_PER_LIST = 2_048
MIN_LISTS, MAX_LISTS = 4, 512
#: Rows of a list that is parted again, as a multiple of the above; levels; rows a task places.
CROWD, LEVELS, PLACED_AT_ONCE = 8, 4, 20_000
CODEWORDS = 64
SUBSPACES = 8
#: Rows of one block; a task compares two blocks, so many rows of one at a time.
BLOCK, COMPARED_AT_ONCE = 4096, 1024
#: Copies of a vector, one in each list it probes, that lie on disk at once.
COPIES = 4
#: Room for rounding in the two distance tests.
SLACK = 1e-6


@dataclass
class Index:
    """Coarse centroids and, for each subspace, codewords of the residual."""

    centroids: np.ndarray
    codebooks: list[np.ndarray]
    edges: list[int]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    squares = (centres**2).sum(1)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = np.argmin(squares - 2 * x[at : at + 4096] @ centres.T, axis=1)
    return out


def _centres(x: np.ndarray, k: int, rounds: int = 8, seed: int = 17) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def fit_index(x: np.ndarray, lists: int = MIN_LISTS, subspaces: int = SUBSPACES, codewords: int = CODEWORDS) -> Index:
    """Fit on unit vectors (rows of ``x``)."""
    centroids = _centres(x, int(np.clip(lists, 1, max(1, len(x) // 16))))
    residual = x - centroids[_nearest(x, centroids)]
    edges = np.linspace(0, x.shape[1], min(subspaces, x.shape[1]) + 1).astype(int).tolist()
    return Index(centroids, [_centres(residual[:, a:b], codewords) for a, b in zip(edges, edges[1:], strict=False)], edges)


def reach(centroids: np.ndarray, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, and [row, centroid]: whether a vector that belongs to
    the centroid can lie within ``radius`` of the row."""
    square = (x**2).sum(1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(1)[None, :]
    own = np.argmin(square, axis=1)
    apart = np.sqrt(np.maximum(((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2), 0))[own]
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.where(apart > 0, (square - square[np.arange(len(x)), own][:, None]) / (2 * apart), 0.0)
    return own, far <= radius + SLACK


def assign(index: Index, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Own list, code and error of each row, and [row, list]: own list and those to probe
    (of smaller number)."""
    own, near = reach(index.centroids, x, radius)
    near &= np.arange(near.shape[1])[None, :] <= own[:, None]
    residual = x - index.centroids[own]
    code = np.stack([_nearest(residual[:, a:b], book) for (a, b), book in zip(zip(index.edges, index.edges[1:], strict=False), index.codebooks, strict=True)], axis=1)
    decoded = np.concatenate([book[code[:, j]] for j, book in enumerate(index.codebooks)], axis=1)
    return own, code.astype(np.uint8), np.sqrt(((residual - decoded) ** 2).sum(1)), near


def _units(vectors: np.ndarray) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(1))[:, None]


def _compare(index: Index, which: int, base: int, left: dict, right: dict, same: bool, cosine: float, radius: float):
    """Links between two blocks of a list: index pairs (i in left, j in right)."""
    found = []
    # Coded members of one side against the raw vectors of the other.  Visitors (rows
    # of another list) are only raw: two of them meet in a list that one belongs to.
    for members, raw, swapped in ((right, left, False),) if same else ((right, left, False), (left, right, True)):
        m = np.flatnonzero(members["own"] == which)
        q = np.flatnonzero(raw["own"] != which) if swapped else np.arange(len(raw["own"]))
        if not len(m) or not len(q):
            continue
        reach = radius + members["error"][m] + SLACK
        close = []
        for start in range(0, len(q), COMPARED_AT_ONCE):
            residual = raw["x"][q[start : start + COMPARED_AT_ONCE]] - index.centroids[base]
            approx = np.zeros((len(residual), len(m)))
            for j, book in enumerate(index.codebooks):
                part = residual[:, index.edges[j] : index.edges[j + 1]]
                tables = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)[None, :]
                approx += tables[:, members["code"][m, j]]
            x, y = np.nonzero(approx <= (reach**2)[None, :])
            close.append((x + start, y))
        a, b = (np.concatenate(x) for x in zip(*close, strict=True))
        i, j = (m[b], q[a]) if swapped else (q[a], m[b])
        if same:  # members meet each other once, visitors meet members once anyhow
            once = (left["own"][i] != which) | (i < j)
            i, j = i[once], j[once]
        if len(i):
            exact = np.empty(len(i))
            for at in range(0, len(i), 1 << 16):
                part = slice(at, at + (1 << 16))
                exact[part] = np.einsum("ij,ij->i", left["x"][i[part]], right["x"][j[part]])
            hit = exact >= cosine
            found.append(np.stack([i[hit], j[hit]]))
    return np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)


def _spanning(n: int, pairs: np.ndarray, names: np.ndarray) -> list[tuple[int, int]]:
    """(name, least name of its component) from pairs among ``n`` nodes."""
    root = list(range(n))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in pairs.T.tolist():
        a, b = find(a), find(b)
        if a != b:
            if names[a] < names[b]:
                root[b] = a
            else:
                root[a] = b
    touched = np.unique(pairs)
    return [(int(names[a]), int(names[find(a)])) for a in touched.tolist() if find(a) != a]


def _bytes_of(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    flat = np.ascontiguousarray(rows)
    width = flat.dtype.itemsize * flat.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(flat), [None, pa.py_buffer(flat.tobytes())]).cast(pa.binary())


def part_crowded(placed: DataFrame, radius: float, width: str, rows_per_list: int, crowd: int, max_lists: int) -> tuple[DataFrame, list[DataFrame]]:
    """``placed`` with its crowded lists parted, level by level; and what was written for it.

    A list's number is its parent's times 1024 plus its own, so numbers never meet; rows
    that visit a list visit every part of it that could hold a partner.
    """
    key = ["label", "size", "list"]
    columns = placed.columns
    done, written = None, []
    for _ in range(LEVELS):
        sizes = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("own") == F.col("list")).alias("members"))
        full = cut(sizes.where((F.col("n") > crowd) & (F.col("members") > 1)))
        if not full.take(1):
            break
        calm = placed.join(full.select(*key), key, "left_anti")
        done = calm if done is None else done.unionByName(calm)
        rows = placed.join(full, key)
        share = F.least(F.lit(1.0), 2.0 * SAMPLE / F.col("members")) * (1 << 30)
        some = rows.where((F.col("own") == F.col("list")) & (F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < share))

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            x = _units(np.stack([np.frombuffer(v, width) for v in pdf.sort_values("rep")["x"].iloc[:SAMPLE]]))
            wanted = int(np.clip(pdf["members"].iloc[0] // rows_per_list, 2, max_lists))
            centres = np.unique(_centres(x, min(wanted, max(2, len(x) // 16))), axis=0)
            return pdf[key].iloc[:1].assign(k=len(centres), centres=[centres.tobytes()])

        # One model a crowded list, each of at most max_lists vectors, handed to every slice of it.
        models = cut(some.groupBy(*key).applyInPandas(fit, "label string, size int, list long, k int, centres binary"))
        slices = F.ceil(F.col("n") / PLACED_AT_ONCE).cast("int")
        sent = models.join(full, key).select(*key, "k", "centres", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
        rows = rows.select(*columns, F.pmod(F.xxhash64("rep", "own"), slices).cast("int").alias("slice"))

        def split(pdf: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
            if not len(pdf):
                return pdf[columns]
            x = _units(np.stack([np.frombuffer(v, width) for v in pdf["x"]]))
            centres = np.frombuffer(model["centres"].iloc[0]).reshape(int(model["k"].iloc[0]), -1)
            nearest, near = reach(centres, x, radius)
            member = (pdf["own"] == pdf["list"]).to_numpy()
            near &= ~member[:, None] | (np.arange(len(centres))[None, :] <= nearest[:, None])
            row, at = np.nonzero(near)
            out = pdf[columns].iloc[row].copy()
            parent = out["list"].to_numpy() * 1024
            out["own"] = np.where(member[row], parent + nearest[row], out["own"].to_numpy())
            out["list"] = parent + at
            return out

        placed = cut(rows.groupBy(*key, "slice").cogroup(sent.groupBy(*key, "slice")).applyInPandas(split, placed.schema))
        written += [full, models, placed]
    return placed if done is None else done.unionByName(placed), written


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    *,
    cosine: float = 0.98,
    sample: int = SAMPLE,
    rows_per_list: int = ROWS_PER_LIST,
    block: int = BLOCK,
    crowd: int | None = None,
    max_lists: int = MAX_LISTS,
    copies: int = COPIES,
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    if not 2 <= max_lists <= 1024:
        raise ValueError("a level holds 2 to 1024 lists")
    spark = vectors.sparkSession
    ship(spark)
    radius = float(np.sqrt(2 - 2 * cosine))
    # Vectors travel in the precision they came in; all arithmetic is in double.
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind, width = ("array<float>", "<f4") if single else ("array<double>", "<f8")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"), F.col(label_col).alias("label"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = (
        F.col("v").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") > 0)
        & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    )
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    good = rows.where("usable").drop("usable")
    reps = cut(good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")))
    # A bounded sample: at most ``sample`` vectors reach the driver.
    n = reps.count()
    share = int(min(1.0, 2 * sample / max(n, 1)) * (1 << 30))
    likely = reps.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < share)
    taken = [r["v"] for r in likely.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("v").collect()]
    by_size: dict[int, list] = {}
    for v in taken:
        by_size.setdefault(len(v), []).append(v)
    # Labels never meet, so the largest of them says how many lists are worth their visitors.
    largest = reps.groupBy("label", F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    lists = int(np.clip(largest // rows_per_list, min(MIN_LISTS, max_lists), max_lists))
    fitted = {d: fit_index(_units(v), lists) for d, v in by_size.items()}

    def index_for(size: int) -> Index:
        # A length that the sample missed has one list, and codes that say nothing.
        if size not in fitted:
            fitted[size] = Index(np.zeros((1, size)), [np.zeros((1, size))], [0, size])
        return fitted[size]

    placed_schema = "label string, size int, list long, own long, base int, rep long, weight long, x binary, code binary, error float"
    names = [f.strip().split(" ")[0] for f in placed_schema.split(",")]

    seen = [assign(fitted[d], _units(v[:COMPARED_AT_ONCE]), radius)[3].sum(axis=1) for d, v in by_size.items()]
    waves = max(1, *(int(np.ceil(x.mean() / copies)) for x in seen)) if seen else 1

    def place(batches: Iterator[pa.RecordBatch], wave: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, v, rep, weight = batch.columns
            values, ends = v.flatten().to_numpy(zero_copy_only=False), np.cumsum(v.value_lengths().to_numpy())
            sizes = v.value_lengths().to_numpy()
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                x = values[(ends[at] - size)[:, None] + np.arange(size)].astype(width)
                own, code, error, near = assign(index_for(size), _units(x), radius)
                row, which = np.nonzero(near & (np.arange(near.shape[1]) % waves == wave))
                take = pa.array(at[row])
                # Top lists are numbered from 1, so that no part bears a top list's number.
                columns = [
                    label.take(take), pa.array(np.full(len(row), size, np.int32)), pa.array(which + 1), pa.array(own[row] + 1), pa.array(which.astype(np.int32)),
                    rep.take(take), weight.take(take), _bytes_of(x[row]), _bytes_of(code[row]), pa.array(error[row].astype(np.float32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    labelled = reps.select(F.col("label").cast("string").alias("label"), "v", "rep", "weight")
    key = ["label", "size", "list"]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        size, which, base = (int(pdf[c].iloc[0]) for c in ("size", "list", "base"))
        p, q = int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0])
        index = index_for(size)
        pdf = pdf.sort_values(["b", "rep"], kind="stable")

        def side(part: pd.DataFrame) -> dict:
            return {
                "x": _units(np.stack([np.frombuffer(x, width) for x in part["x"]])) if len(part) else np.empty((0, size)),
                "own": part["own"].to_numpy(),
                "code": np.stack([np.frombuffer(c, np.uint8) for c in part["code"]]) if len(part) else np.empty((0, 1), np.uint8),
                "error": part["error"].to_numpy().astype(np.float64),
            }

        left_rows, right_rows = pdf[pdf["b"] == p], pdf[pdf["b"] == q]
        pairs = _compare(index, which, base, side(left_rows), side(right_rows), p == q, cosine, radius)
        if p == q:
            names, weights, shift = left_rows["rep"].to_numpy(), left_rows["weight"].to_numpy(), 0
        else:
            shift = len(left_rows)
            names = np.concatenate([left_rows["rep"].to_numpy(), right_rows["rep"].to_numpy()])
            weights = np.concatenate([left_rows["weight"].to_numpy(), right_rows["weight"].to_numpy()])
        pairs = pairs + np.array([[0], [shift]])
        linked = np.zeros(len(names), np.int64)
        np.add.at(linked, pairs[0], weights[pairs[1]])
        np.add.at(linked, pairs[1], weights[pairs[0]])
        lead = dict(_spanning(len(names), pairs, names))
        at = np.flatnonzero(linked)
        return pd.DataFrame({"rep": names[at], "links": linked[at], "lead": [lead.get(int(n), int(n)) for n in names[at]]})

    found = None
    for wave in range(waves):
        here = cut(labelled.mapInArrow(partial(place, wave=wave), placed_schema))
        placed, written = part_crowded(here, radius, width, rows_per_list, crowd or CROWD * rows_per_list, max_lists)
        # Written apart, so that Spark may split the rows of a crowded list in the join.
        sizes = cut(placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        blocked = placed.join(sizes, key).withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int"))
        blocked = blocked.withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        # Each block meets each: (b, every other) as a sorted pair.
        met = blocked.select(*placed.columns, "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select(
            *placed.columns, "b", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q")
        )
        links = cut(met.groupBy("label", "size", "list", "p", "q").applyInPandas(compare, "rep long, links long, lead long"))
        forget(here, sizes, *written)
        found = links if found is None else found.unionByName(links)
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = connected_components(found.where("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")))
    named = (
        reps.join(counts, "rep", "left")
        .join(classes.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    done = good.join(named, ["label", "v"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
