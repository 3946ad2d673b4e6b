"""Questions as text: an inverted index over split identifiers, searched exactly with early termination.

The index has one row per (term, id) with the term's weight there, and one per term
with its document frequency and its bound, the greatest of its weights. Postings and
questions are dealt to the cells of a grid, and only a cell's k best of each question
leave it. In a cell a question's terms are taken in order of their bounds. Its rarest
lists alone give a lower bound of the k-th best score; the terms whose bounds together
stay below that can't lift a document into the answer on their own, so only documents
in the lists of the others are candidates. No table has a row a candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import save
from .vectors import grid

#: Saturation of a term's repeats.
SATURATION = 1.2
#: Entries, by the number of answers, that the lists opened for the first bound hold (the last list may have more).
FIRST = 4
#: Places to which scores are rounded before they are ranked, and by which bounds give way.
PLACES = 6
_SLACK = 10.0**-PLACES
#: Postings and terms of questions in a cell, about.
CELL_POSTINGS, CELL_TERMS = 500_000, 200_000


def terms(text: Column) -> Column:
    """The lower-case parts of words and identifiers: camel case, underscores and signs separate; null text has none."""
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(\p{Ll}|\p{N})(\p{Lu})", "$1 $2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.transform(F.regexp_extract_all(spaced, F.lit(r"\p{L}+|\p{N}+"), F.lit(0)), F.lower)


class TextIndex:
    """``postings`` (term, id, weight) and ``lists`` (term, df, bound) of the texts ``rows`` (id, text), one row an id."""

    def __init__(self, rows: DataFrame):
        found = rows.select("id", F.explode_outer(terms(F.col("text"))).alias("term")).where("term is not null")
        counts = save(found.groupBy("term", "id").agg(F.count("*").alias("tf")), "lexical-counts")
        n = rows.count()
        df = counts.groupBy("term").agg(F.count("*").alias("df"), F.max("tf").alias("most"))
        idf = F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        weight = lambda tf: F.col("idf") * tf / (tf + SATURATION)
        lists = df.withColumn("idf", idf)
        self.lists = save(lists.select("term", "df", "idf", weight(F.col("most")).alias("bound")), "lexical-lists")
        self.postings = save(counts.join(self.lists, "term").select("term", "id", weight(F.col("tf")).alias("weight")), "lexical-postings")

    def search(self, questions: DataFrame, k: int, groups: DataFrame | None = None) -> DataFrame:
        """Rows (query_id, id, score, rank): the k best of each question (query_id, text), ties by id.

        With ``groups`` (id, group) questions have a group too, and only ids of their
        own are answers (one id may be in several).

        A score is the sum of the weights of the question's distinct terms. Questions
        without a known term have no rows.
        """
        return self.explain(questions, k, groups)[0]

    def explain(self, questions: DataFrame, k: int, groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The answers, and rows (query_id, candidates): how many documents were scored."""
        own = F.lit("").alias("of") if groups is None else F.col("group").alias("of")
        postings = self.postings if groups is None else self.postings.join(groups.select("id", "group").distinct(), "id")
        asked = questions.select("query_id", own, F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct()
        known = asked.join(self.lists, "term").select("query_id", "of", "term", "bound")
        shown = [f"{c} {t.schema[c].dataType.simpleString()}" for t, c in ((known, "query_id"), (postings, "id"))]
        cells = grid(postings.select("id", own, "term", "weight"), known, ["of"], ("id", "query_id"), (CELL_POSTINGS, CELL_TERMS))
        found = save(cells.applyInArrow(lambda p, q: _best(p, q, k), f"{', '.join(shown)}, score double, candidates long"), "lexical-best")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        answers = found.drop("candidates").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return answers, found.groupBy("query_id").agg(F.sum("candidates").alias("candidates"))


def _best(postings, asked, k: int):
    """The k best of a cell for each of its questions, with their scores and, in a question's first row, its candidates."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def numbers(column):
        """Places in the order of the distinct values, and the values."""
        values = pc.unique(column)
        values = values.take(pc.sort_indices(values))
        return pc.index_in(column, values).to_numpy(zero_copy_only=False), values

    doc, ids = numbers(postings.column("id").combine_chunks())
    terms_ = pc.unique(postings.column("term").combine_chunks())
    term = pc.index_in(postings.column("term").combine_chunks(), terms_).to_numpy(zero_copy_only=False)
    order = np.argsort(term, kind="stable")
    doc, weight = doc[order], postings.column("weight").to_numpy()[order]
    start = np.searchsorted(term[order], np.arange(len(terms_) + 1))
    mine, queries = numbers(asked.column("query_id").combine_chunks())
    # A question's terms lie together, the greatest bound first; those that the cell lacks count no more.
    known = pc.index_in(asked.column("term").combine_chunks(), terms_)
    at = known.fill_null(-1).to_numpy(zero_copy_only=False)
    bound = asked.column("bound").to_numpy()
    order = np.lexsort((at, -bound, mine))
    order = order[at[order] >= 0]
    mine, at, bound = mine[order], at[order], bound[order]
    ends = np.searchsorted(mine, np.arange(len(queries) + 1))
    out = []
    for q in range(len(queries)):
        own, b = at[ends[q] : ends[q + 1]], bound[ends[q] : ends[q + 1]]
        if not len(own):
            continue
        size = start[own + 1] - start[own]
        ahead, later = np.cumsum(size) - size, np.cumsum(b[::-1])[::-1]
        lists = [slice(start[t], start[t + 1]) for t in own]
        total = lambda chosen: np.bincount(np.concatenate([doc[x] for x in chosen]), np.concatenate([weight[x] for x in chosen]), len(ids))
        first = total(lists[: int((ahead < FIRST * k).sum())])
        least = np.partition(first, -k)[-k] if len(first) >= k else 0.0
        opened = max(1, int((later + _SLACK >= least).sum()))
        maybe = np.zeros(len(ids), bool)
        for x in lists[:opened]:
            maybe[doc[x]] = True
        maybe = np.flatnonzero(maybe)
        score = np.floor(total(lists)[maybe] * 10.0**PLACES + 0.5)
        kept = np.arange(len(maybe)) if len(maybe) <= k else np.flatnonzero(score >= np.partition(score, -k)[-k])
        kept = kept[np.lexsort((maybe[kept], -score[kept]))[:k]]
        out.append((np.full(len(kept), q), maybe[kept], score[kept] / 10.0**PLACES, np.concatenate(([len(maybe)], np.zeros(len(kept) - 1, int)))))
    of, to, score, n = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int),) * 2 + (np.zeros(0), np.zeros(0, int))
    return pa.table({"query_id": queries.take(pa.array(of)), "id": ids.take(pa.array(to)), "score": pa.array(score), "candidates": pa.array(n, pa.int64())})
