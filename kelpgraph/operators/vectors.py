"""Chunks, exact vector search and question context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import naming
from . import degrees

#: Vectors and queries that meet in one cell of the grid, at most on average.
CELL_VECTORS, BROADCAST_QUERIES = 8192, 2048
#: Lines of what lies around a hit.
LINES = 30
#: Queries of a cell whose distances are held at once.
_AT_ONCE = 256


def distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def _matrix(column, width: int):
    """Numbers and which of them are there; shorter and null lists lack the rest."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    row, flat = pc.list_parent_indices(column).to_numpy(), pc.list_flatten(column).cast(pa.float64())
    place = np.arange(len(row)) - np.searchsorted(row, row)
    values, there = np.zeros((len(column), width)), np.zeros((len(column), width), bool)
    values[row, place], there[row, place] = flat.fill_null(0).to_numpy(zero_copy_only=False), flat.is_valid().to_numpy(zero_copy_only=False)
    return values, there


def _nearest(vectors, queries, k: int):
    """The k nearest vectors of each query of a cell: products of matrices tell who may be, the sum in order of coordinates decides."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    vectors = vectors.take(pc.sort_indices(vectors, [("vec_id", "ascending")]))  # ties go by place
    ends = [t.column(c).combine_chunks() for t, c in ((vectors, "embedding"), (queries, "q"))]
    width = max(pc.max(pc.list_value_length(e)).as_py() or 0 for e in ends)
    (v, v_there), (q, q_there) = (_matrix(e, width) for e in ends)
    odd_v, odd_q = (~np.isfinite(x).all(1) for x in (v, q))
    v0, q0 = np.where(odd_v[:, None], 0, v), np.where(odd_q[:, None], 0, q)
    v2, q2 = v0 * v0, q0 * q0
    slack = 1e-9 * (v2.sum(1).max(initial=0) + q2.sum(1).max(initial=0))
    found = []
    for at in range(0, len(q), _AT_ONCE):
        part = slice(at, at + _AT_ONCE)
        near = q_there[part].astype(float) @ v2.T - 2 * (q0[part] @ v0.T) + q2[part] @ v_there.T.astype(float)
        near[:, odd_v] = np.inf
        near[~((q_there[part] @ v_there.T) > 0)] = np.inf  # no coordinate in common
        kth = np.partition(near, k - 1, axis=1)[:, k - 1 : k] if k <= len(v) else np.full((len(near), 1), np.inf)
        of, to = np.nonzero((near <= kth + slack) | odd_v[None, :] | odd_q[part, None])
        of += at
        d, none = np.zeros(len(of)), np.ones(len(of), bool)
        with np.errstate(invalid="ignore", over="ignore"):
            for j in range(width):
                both = v_there[to, j] & q_there[of, j]
                step = v[to, j] - q[of, j]
                d += np.where(both, step * step, 0)
                none &= ~both
        order = np.lexsort((to, d, none, of))
        first = np.searchsorted(of[order], of[order])
        order = order[np.arange(len(order)) - first < k]
        found.append((of[order], to[order], d[order], none[order]))
    of, to, d, none = (np.concatenate(x) for x in zip(*found))
    return pa.table({"query_id": queries.column("query_id").take(pa.array(of)), "vec_id": vectors.column("vec_id").take(pa.array(to)), "d": pa.array(d, mask=none)})


def grid(left: DataFrame, right: DataFrame, key: list[str], ids: tuple[str, str], sizes: tuple[int, int]):
    """Both tables dealt to the cells of a grid per ``key``, by the hashes of their ids, so that every row of one meets every row of the other; a cell has about ``sizes`` rows."""
    parts = lambda t, name, size: t.groupBy(*key).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    shape = parts(left, "rows", sizes[0]).join(parts(right, "columns", sizes[1]), key)
    line = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = lambda x, n: F.pmod(F.xxhash64(x), F.col(n)).cast("int")
    a = left.join(shape, key).withColumn("row", at(ids[0], "rows")).withColumn("column", line("columns")).drop("rows", "columns")
    b = right.join(shape, key).withColumn("column", at(ids[1], "columns")).withColumn("row", line("rows")).drop("rows", "columns")
    cell = [*key, "row", "column"]
    return a.groupBy(*cell).cogroup(b.groupBy(*cell))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, same: str | None = None) -> DataFrame:
    """V1, V2: the k nearest vectors (vec_id, embedding) of each query (query_id, q); ``same`` filters by an equal column first.

    Blocks of vectors and of queries meet in the cells of a grid; a cell passes on its
    k best a query. Coordinates that one side lacks don't count; a pair without any has
    no distance and comes last.
    """
    of = F.col(same) if same else F.lit(0)
    v, q = vectors.select(of.alias("of"), "vec_id", "embedding"), queries.select(of.alias("of"), "query_id", "q")
    types = [f"query_id {q.schema['query_id'].dataType.simpleString()}", f"vec_id {v.schema['vec_id'].dataType.simpleString()}", "d double"]
    cells = grid(v, q, ["of"], ("vec_id", "query_id"), (CELL_VECTORS, BROADCAST_QUERIES))
    best = cells.applyInArrow(_cell(k), ", ".join(types))
    rank = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("d"), "vec_id")
    return best.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def _cell(k: int):
    def cell(vectors, queries):
        if not len(vectors) or not len(queries):
            return _none(vectors, queries)
        return _nearest(vectors, queries, k)

    return cell


def _none(vectors, queries):
    import pyarrow as pa

    return pa.table({"query_id": queries.column("query_id").slice(0, 0), "vec_id": vectors.column("vec_id").slice(0, 0), "d": pa.array([], pa.float64())})


def chunks(nodes: DataFrame, classes: DataFrame, calls: DataFrame, summarise: Callable[[Column, Column], Column] | None = None, failed: bool = False) -> DataFrame:
    """One chunk per method, with its layer and both degrees; the summary is a template unless given.

    Methods whose summary is null are left out, or kept for ``index_run`` to count (``failed``).
    """
    path = classes.groupBy(F.col("name").alias("class_name")).agg(F.min("file_path").alias("file_path"))
    out = degrees.out_degrees(nodes, calls).join(degrees.in_degrees(nodes, calls.where("type <> 'unknown'")), ["name", "class_name"]).join(path, "class_name")
    text = (summarise or (lambda c, m: F.concat(F.lit("Method "), m, F.lit(" of "), c)))(F.col("class_name"), F.col("name"))
    return out.select(naming.chunk_id(F.col("file_path"), F.col("class_name"), F.col("name")).alias("id"), text.alias("summary"), "file_path", F.col("name").alias("method_name"), "class_name", naming.layer(F.col("file_path")).alias("layer"), F.col("out_degree").alias("call_count"), F.col("in_degree").alias("callers_count")).where(F.lit(failed) | F.col("summary").isNotNull())


def with_code(chunks: DataFrame, methods: DataFrame) -> DataFrame:
    """Chunks with ``raw_code``, the text of their method of least arity in ``methods`` (path, class_name, name, param_count, code); null where there's none."""
    code = methods.groupBy(F.col("path").alias("file_path"), "class_name", F.col("name").alias("method_name")).agg(F.min_by("code", F.struct("param_count", "start")).alias("raw_code"))
    return chunks.join(code, ["file_path", "class_name", "method_name"], "left")


def to_index(wanted: DataFrame, stored: DataFrame, top: int | None = None) -> DataFrame:
    """Chunks that aren't stored yet, the most called first if only ``top`` are wanted."""
    chosen = wanted if top is None else wanted.orderBy(F.desc("callers_count"), "id").limit(top)
    return chosen.join(stored.select("id").distinct(), "id", "left_anti")


def prioritised(wanted: DataFrame, hot: DataFrame, top: int) -> DataFrame:
    """The ``top`` chunks of the most called methods of ``hot`` (key, n), a key being Class.method or a bare name.

    A key that names no chunk in full falls back to all chunks of that method name.
    """
    keyed = wanted.withColumn("key", naming.method_key(F.col("class_name"), F.col("method_name")))
    full = keyed.join(hot, "key")
    bare = hot.join(keyed.select("key").distinct(), "key", "left_anti").select(F.element_at(F.split("key", r"\."), -1).alias("method_name"), "n")
    found = full.drop("key").unionByName(keyed.drop("key").join(bare, "method_name"))
    return found.groupBy(*wanted.columns).agg(F.max("n").alias("n")).orderBy(F.desc("n"), "id").limit(top)


def index_run(wanted: DataFrame, stored: DataFrame, top: int | None = None) -> tuple[DataFrame, DataFrame]:
    """V4: the stored chunks after a run, and one row (total, indexed, skipped, failed).

    Chunks that are stored already are skipped; a chunk without a summary (the
    summariser gave null) failed and isn't stored.
    """
    chosen = wanted if top is None else wanted.orderBy(F.desc("callers_count"), "id").limit(top)
    have = stored.select("id").distinct().withColumn("there", F.lit(True))
    marked = chosen.join(have, "id", "left")
    new, ok = F.col("there").isNull(), F.col("summary").isNotNull()
    counts = marked.agg(F.count("*").alias("total"), F.count_if(new & ok).alias("indexed"), F.count_if(~new).alias("skipped"), F.count_if(new & ~ok).alias("failed"))
    return stored.unionByName(marked.where(new & ok).select(*stored.columns)), counts


def stored_ids(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked id whether it is stored, and how many chunks are."""
    have = stored.select("id").distinct().withColumn("there", F.lit(True))
    total = stored.agg(F.count_distinct("id").alias("stored"))
    return asked.select("id").distinct().join(have, "id", "left").join(total).select("id", F.coalesce("there", F.lit(False)).alias("there"), "stored")


def hits(nearest: DataFrame, owners: DataFrame) -> DataFrame:
    """V8: rows (query_id, rank, node) of the methods whose vectors were recalled; ``owners`` has vec_id and node."""
    best = nearest.join(owners, "vec_id").groupBy("query_id", "node").agg(F.min("rank").alias("first"))
    return best.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "node")).alias("rank"), "node")


def context(hits: DataFrame, reached: DataFrame, blocks: int = 8, lines: int = LINES) -> DataFrame:
    """V8: per query a text of at most ``blocks`` hits with at most ``lines`` lines of callees or callers each.

    ``hits`` has query_id, rank and node; ``reached`` origin, node, depth, both directions together, or what ``traverse.around``
    leaves of it for as many lines.
    """
    line = F.concat(F.lit("  "), F.col("depth").cast("string"), F.lit(" "), F.col("node"))
    near = reached.select("origin", "depth", "node", line.alias("line")).distinct()
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("origin").orderBy("depth", "node"))).where(F.col("r") <= lines)
    body = near.groupBy("origin").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n").alias("body"))
    shown = hits.where(F.col("rank") <= blocks).join(body, hits["node"] == body["origin"], "left")
    block = F.concat_ws("\n", F.concat(F.lit("# "), shown["node"]), "body")
    return shown.select("query_id", "rank", shown["node"], block.alias("block")).groupBy("query_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n").alias("context"),
        F.array_join(F.sort_array(F.collect_set("node")), ",").alias("refs"))


def chat_context(turns: DataFrame, last: int = 4) -> DataFrame:
    """The last turns of each conversation, as one text."""
    rank = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    kept = turns.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= last)
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", (-F.col("r")).alias("o"), F.concat_ws(": ", "role", "text").alias("line")))), lambda x: x["line"]), "\n").alias("context"))
