"""Keyword search: postings tables, BM25 ranking and typed match clauses.

An index is two tables: one row per (field, term, document) and one per (field, term). The field
length sits in the postings, so scoring needs no join with the documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions import text as X
from nearfield.operators.knn import small, top_k
from nearfield.session import file_count, staged, stored_bytes, widen
from nearfield.sources import generations

K1, B = 1.2, 0.75
_EXPANSIONS = 5_000  # matched terms that still go into the scan filter as literals


FIELD_TOTALS = ""  # the lexicon row of a field as a whole; no token is empty


@dataclass(frozen=True)
class TextIndex:
    """Postings ``(field, term, doc_id, tf, doc_len, leads, positions)`` and a lexicon ``(field,
    term, n_docs, n_tokens)``, whose row with an empty term holds the totals of the field.

    ``leads`` marks the one posting of a document and field whose term stands first there.
    """

    postings: DataFrame
    lexicon: DataFrame
    rows: DataFrame | None = None  # analysed documents of an index that is not stored
    forms: DataFrame | None = None  # (field, kind, form, term), see ``term_forms``

    def matching(self, test: Column) -> DataFrame:
        """Postings whose field and term pass a test.

        A stored index prunes files with it. Otherwise only tokens that pass are grouped.
        """
        if self.rows is None:
            return self.postings.filter(test)
        tokens = self.rows.select("field", "doc_id", "doc_len", F.posexplode("tokens").alias("pos", "term"))
        return tokens.filter(test).groupBy("field", "term", "doc_id", "doc_len").agg(
            F.count("*").alias("tf"),
            (F.min("pos") == 0).alias("leads"),
            F.sort_array(F.collect_list("pos")).alias("positions"),
        )

    def terms(self) -> DataFrame:
        """``(field, term, doc_freq)`` of every term."""
        return self.lexicon.filter(F.col("term") != FIELD_TOTALS).select("field", "term", F.col("n_docs").alias("doc_freq"))

    def stats(self) -> DataFrame:
        """``(field, n_docs, total_len, avg_len)``; documents without a token do not count."""
        totals = self.lexicon.filter(F.col("term") == FIELD_TOTALS)
        mean = F.col("n_tokens") / F.col("n_docs")
        return totals.select("field", "n_docs", F.col("n_tokens").alias("total_len"), mean.alias("avg_len"))

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextIndex:
        """A stored index, all its generations read as one.

        Lexicon totals of generations add up. Documents marked as deleted in a later generation
        than their postings stay out of the search; the totals have lost them already.
        """
        entries = generations.complete(spark, path)
        known = [r["generation"] for r in entries]
        of = lambda table: spark.read.parquet(f"{path}/{table}").filter(F.col("generation").isin(known))
        postings, lexicon = of("postings"), of("lexicon")
        if len(known) > 1:
            sums = (F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            lexicon = lexicon.groupBy("field", "term").agg(*sums).filter("n_docs > 0")
        n_marks = sum(r["n_out"] for r in entries)
        if n_marks:
            marks = of("deleted").select(F.col("doc_id").alias("_gone"), F.col("generation").alias("_since"))
            gone = (F.col("doc_id") == F.col("_gone")) & (F.col("generation") < F.col("_since"))
            postings = postings.join(small(marks, n_marks), gone, "left_anti")
        forms = None
        if all("forms" in r["has"] for r in entries if r["n_rows"]) and any(r["n_rows"] for r in entries):
            forms = of("forms").drop("generation")
        return TextIndex(postings.drop("generation"), lexicon.drop("generation"), None, forms)


def build_index(docs: DataFrame, fields: Sequence[str], id_col: str = "doc_id") -> TextIndex:
    """A text index of the given string columns, as lazy tables over ``docs``.

    All fields come from one pass over the rows, and the tokens of a document are folded to
    postings inside the task that analysed it. To search the same documents often, store the
    index instead.
    """
    rows = _analysed(docs, fields, id_col).select("field", "doc_id", "doc_len", "tokens")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"field string, term string, doc_id {id_type}, tf long, doc_len long, leads boolean, positions array<int>"
    words = F.concat(F.array(F.lit(FIELD_TOTALS)), F.array_distinct("tokens"))
    lexicon = rows.select("field", "doc_len", F.explode(words).alias("term")).groupBy("field", "term")
    lexicon = lexicon.agg(F.count("*").alias("n_docs"), F.sum("doc_len").alias("n_tokens"))
    return TextIndex(rows.mapInArrow(_fold_postings, schema), lexicon, rows)


def _analysed(docs: DataFrame, fields: Sequence[str], id_col: str) -> DataFrame:
    """``(doc_id, field, tokens, doc_len)`` of every field that holds a token."""
    per_field = F.array(*(F.struct(F.lit(f).alias("field"), X.tokenize(F.col(f)).alias("tokens")) for f in fields))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(per_field).alias("part"))
    rows = rows.select("doc_id", "part.field", "part.tokens").filter(F.size("tokens") > 0)
    return rows.withColumn("doc_len", F.size("tokens").cast("long"))


def store_index(
    docs: DataFrame, fields: Sequence[str], path: str, files: int | None = None, id_col: str = "doc_id", forms: bool = False
) -> TextIndex:
    """Write a text index so that a search reads only the files that hold its terms.

    The one shuffle carries folded postings, ranged on (field, term, document): a frequent term
    spans many files. Postings are staged before that, because range partitioning reads its input
    twice; without ``files`` their number follows from the size of what was staged. The lexicon is counted from the stored postings. With ``forms`` its terms are stored by
    the forms that fuzzy and wildcard clauses look them up by. An index that was there before is
    replaced at once, when the new one is complete.
    """
    spark = docs.sparkSession
    postings = staged(build_index(docs, fields, id_col).postings, "postings")
    return _add_generation(spark, path, postings, files, folds=tuple(generations.live(spark, path)), forms=forms)


def append_index(
    docs: DataFrame, fields: Sequence[str], path: str, files: int | None = None, id_col: str = "doc_id", replace_docs: bool = False
) -> TextIndex:
    """Add documents to a stored index as a generation of their own; no file of it is rewritten.

    Terms get their forms if those of the index have them. With ``replace_docs`` the documents take the place of those with the same ids.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), *fields)
    postings = staged(build_index(rows, fields).postings, "postings")
    forms = TextIndex.load(spark, path).forms is not None
    return _add_generation(spark, path, postings, files, rows.select("doc_id") if replace_docs else None, forms=forms)


def delete_documents(ids: DataFrame, path: str) -> TextIndex:
    """Take the documents with the ids ``(doc_id)`` out of a stored index.

    Marks are written, no postings are. One scan of the postings finds what the documents have
    added to the lexicon; a generation with negative counts takes it back.
    """
    spark = ids.sparkSession
    return _add_generation(spark, path, TextIndex.load(spark, path).postings.limit(0), 1, marks=ids.select("doc_id"))


def compact_index(spark: SparkSession, path: str, files: int | None = None) -> TextIndex:
    """Fold all generations of a stored index into one, without the deleted documents."""
    live = generations.live(spark, path)
    if len(live) < 2:
        return TextIndex.load(spark, path)
    index = TextIndex.load(spark, path)
    return _add_generation(spark, path, staged(index.postings, "postings"), files, folds=tuple(live), forms=index.forms is not None)


def _add_generation(
    spark: SparkSession,
    path: str,
    postings: DataFrame,
    files: int | None,
    marks: DataFrame | None = None,
    folds: tuple[int, ...] = (),
    forms: bool = False,
) -> TextIndex:
    number = generations.highest(spark, path) + 1
    ranged = postings.repartitionByRange(files or file_count(spark, stored_bytes(postings)), "field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id")
    ranged.write.mode("overwrite").parquet(f"{path}/postings/generation={number}")
    counts = _counted(spark.read.parquet(f"{path}/postings/generation={number}"), 1)
    n_marks = 0
    if marks is not None:
        marks = staged(marks.distinct(), "marks")
        n_marks = marks.count()
        marks.coalesce(max(1, n_marks // 1_000_000)).write.mode("overwrite").parquet(f"{path}/deleted/generation={number}")
        before = TextIndex.load(spark, path).postings
        counts = counts.unionByName(_counted(before.join(small(marks, n_marks), "doc_id", "left_semi"), -1))
        sums = (F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "_tf", "_leads"))
        counts = counts.groupBy("field", "term").agg(*sums)
    counts = staged(counts, "lexicon")
    totals = counts.groupBy("field").agg(F.sum("_leads").alias("n_docs"), F.sum("_tf").alias("n_tokens"))
    totals = totals.withColumn("term", F.lit(FIELD_TOTALS))
    lexicon = counts.drop("_tf", "_leads").unionByName(totals)
    lexicon = lexicon.repartitionByRange("field", "term").sortWithinPartitions("field", "term")
    lexicon.write.mode("overwrite").parquet(f"{path}/lexicon/generation={number}")
    n_rows = spark.read.parquet(f"{path}/postings/generation={number}").count()
    if forms and n_rows:
        made = staged(term_forms(spark.read.parquet(f"{path}/lexicon/generation={number}").filter("n_docs > 0")), "forms")
        made = made.repartitionByRange("field", "kind", "form").sortWithinPartitions("field", "kind", "form")
        made.write.mode("overwrite").parquet(f"{path}/forms/generation={number}")
    generations.enter(spark, path, number, n_rows, n_marks, folds, has=("forms",) if forms and n_rows else ())
    return TextIndex.load(spark, path)


def _counted(postings: DataFrame, sign: int) -> DataFrame:
    """What postings add to the lexicon, or take from it."""
    counts = postings.groupBy("field", "term").agg(
        F.count("*").alias("n_docs"), F.sum("doc_len").alias("n_tokens"), F.sum("tf").alias("_tf"), F.count_if("leads").alias("_leads")
    )
    return counts.select("field", "term", *((F.col(c) * sign).alias(c) for c in ("n_docs", "n_tokens", "_tf", "_leads")))


_HEAD = 8  # characters of a term from which letters are left out
_END = "\x00"  # between the end of a rotated term and its beginning; in no token


def left_out(text: str, edits: int = 2) -> set[str]:
    """The head of a text with up to ``edits`` letters left out.

    Texts within that many edits have one of these in common: an edit in the head costs each of
    them one letter at most, the one it changes or the one that it pushes out of the head.
    """
    forms = {text[:_HEAD]}
    for _ in range(edits):
        forms |= {f[:i] + f[i + 1 :] for f in forms for i in range(len(f))}
    return forms


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            columns: list[list] = [[], [], [], []]
            for field, term in zip(*(whole.slice(at, 500)[c].to_pylist() for c in ("field", "term"))):
                rotated = {term[i:] + _END + term[:i] for i in range(len(term) + 1)}
                for kind, forms in (("left out", left_out(term)), ("rotated", rotated)):
                    for column, value in zip(columns, ([field] * len(forms), [kind] * len(forms), forms, [term] * len(forms))):
                        column.extend(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["field", "kind", "form", "term"])


def term_forms(lexicon: DataFrame) -> DataFrame:
    """``(field, kind, form, term)``: terms by what fuzzy and wildcard clauses look for.

    Kind "left out" has the head of a term with up to two letters missing, kind "rotated" every
    rotation of it. Sorted by form, a lookup reads a few row groups.
    """
    terms = widen(lexicon.filter(F.col("term") != FIELD_TOTALS).select("field", "term"))
    return terms.mapInArrow(_forms, "field string, kind string, form string, term string")


def _form_test(c: Clause) -> Column:
    """Forms of all terms that can match a wildcard or fuzzy clause, and few others."""
    form = F.col("form")
    if c.kind == "fuzzy":
        return (F.col("kind") == "left out") & form.isin(sorted(left_out(c.text, c.edits)))
    first, *middle = c.text.split("*")
    last = middle.pop() if middle else None
    # A rotation brings what stands behind the last star in front of what stands before the first.
    around = _END + first if last is None else last + _END + first
    runs = [around.split("?")[0], *(run for part in middle for run in part.split("?"))]
    return (F.col("kind") == "rotated") & form.startswith(max(runs, key=len))


def _fold_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token lists to one row per distinct term of each list, with its positions in order."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1_000):
            batch = whole.slice(at, 1_000)
            tokens = batch.column("tokens")
            lengths = np.diff(tokens.offsets.to_numpy())
            doc = np.repeat(np.arange(batch.num_rows), lengths)
            pos = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            coded = tokens.flatten().dictionary_encode()
            n_terms = max(1, len(coded.dictionary))
            key = doc * n_terms + coded.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(key) else np.zeros(0, np.int64)
            ends = np.r_[starts, len(key)]
            row, term = np.divmod(key[order][starts], n_terms)
            taken = batch.select(["field", "doc_id", "doc_len"]).take(pa.array(row))
            positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pos[order], pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [
                    taken.column("field"),
                    coded.dictionary.take(pa.array(term)),
                    taken.column("doc_id"),
                    pa.array(np.diff(ends), pa.int64()),
                    taken.column("doc_len"),
                    pa.array(pos[order][starts] == 0),
                    positions,
                ],
                names=["field", "term", "doc_id", "tf", "doc_len", "leads", "positions"],
            )


@dataclass(frozen=True)
class Clause:
    """One condition of a keyword query; see ``match``, ``phrase``, ``prefix`` and the others."""

    kind: str
    text: str
    field: str | None = None
    boost: float = 1.0
    occur: str = "should"
    high: str | None = None
    edits: int = 2
    transpositions: bool = True
    inclusive: tuple[bool, bool] = (True, True)
    terms: tuple[str, ...] = ()
    parts: tuple[Clause, ...] = ()
    at_least: int | None = None


def match(text: str, field: str | None = None, boost: float = 1.0) -> Clause:
    """Any token of the text, BM25 scored; every token counts as its own optional clause."""
    return Clause("match", text, field, boost)


def phrase(text: str, field: str | None = None, boost: float = 1.0) -> Clause:
    """All tokens next to each other in this order, BM25 scored by phrase frequency."""
    return Clause("phrase", text, field, boost)


def prefix(text: str, field: str | None = None, boost: float = 1.0) -> Clause:
    """Terms that start with the text; scores the boost."""
    return Clause("prefix", text.lower(), field, boost)


def wildcard(pattern: str, field: str | None = None, boost: float = 1.0) -> Clause:
    """Terms that match a pattern with ``*`` (any run) and ``?`` (one character); scores the boost."""
    return Clause("wildcard", pattern.lower(), field, boost)


def fuzzy(
    text: str, field: str | None = None, boost: float = 1.0, edits: int = 2, transpositions: bool = True
) -> Clause:
    """Terms at most ``edits`` insertions, deletions or substitutions away; scores the boost.

    With ``transpositions`` swapping two neighbouring letters is one edit as well.
    """
    if not 0 <= edits <= 2:
        raise ValueError("edits must be 0, 1 or 2")
    return Clause("fuzzy", text.lower(), field, boost, edits=edits, transpositions=transpositions)


def term_range(
    low: str, high: str, field: str | None = None, boost: float = 1.0, inclusive: tuple[bool, bool] = (True, True)
) -> Clause:
    """Terms between two terms in byte order; scores the boost."""
    return Clause("range", low.lower(), field, boost, high=high.lower(), inclusive=inclusive)


def group(*clauses: Clause, at_least: int | None = None, boost: float = 1.0) -> Clause:
    """Clauses that count as one, groups among them; scores the sum of its matches times the boost.

    It matches where all its ``must`` clauses do, none of its ``must_not`` clauses and at least
    ``at_least`` of the others: by default one, or none beside a ``must`` clause.
    """
    if not clauses:
        raise ValueError("a group needs clauses")
    return Clause("group", "", boost=boost, parts=clauses, at_least=at_least)


def must(clause: Clause) -> Clause:
    return replace(clause, occur="must")


def must_not(clause: Clause) -> Clause:
    return replace(clause, occur="must_not")


def _like(pattern: str) -> str:
    escaped = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return escaped.replace("*", "%").replace("?", "_")


def _swaps(text: str) -> set[str]:
    """The text with one pair of neighbouring letters swapped, in every place."""
    return {text[:i] + text[i + 1] + text[i] + text[i + 2 :] for i in range(len(text) - 1)} - {text}


def _fuzzy_test(term: Column, c: Clause) -> Column:
    """Within the edit distance of the text, from distances without swaps to swapped forms of it."""
    near = F.levenshtein(term, F.lit(c.text), c.edits) >= 0
    if not c.transpositions or not c.edits:
        return near
    swapped = sorted(_swaps(c.text))
    if c.edits == 1:
        return near | term.isin(swapped)
    # Two edits of which at least one is a swap: a swap and an edit, two swaps, or a letter that
    # goes from between two letters that change places.
    apart = {c.text[:i] + c.text[i + 2] + c.text[i] + c.text[i + 3 :] for i in range(len(c.text) - 2)}
    twice = sorted(apart.union(*(_swaps(s) for s in swapped)))
    tests = [near, term.isin(twice), *(F.levenshtein(term, F.lit(s), 1) >= 0 for s in swapped)]
    return F.length(term).between(len(c.text) - 2, len(c.text) + 2) & _any_of(tests)


def _term_test(c: Clause) -> Column:
    term = F.col("term")
    if c.kind == "prefix":
        return term.startswith(c.text)
    if c.kind == "wildcard":
        return term.like(_like(c.text))
    if c.kind == "fuzzy":
        return _fuzzy_test(term, c)
    if c.kind == "terms":
        return term.isin(list(c.terms))
    low = term >= c.text if c.inclusive[0] else term > c.text
    high = term <= c.high if c.inclusive[1] else term < c.high
    return low & high


def search(
    index: TextIndex,
    queries: Mapping[object, Sequence[Clause]],
    n: int = 10,
    field: str = "title",
    *,
    k1: float = K1,
    b: float = B,
    compact_norms: bool = False,
) -> DataFrame:
    """Best n documents of every query: ``(query_id, doc_id, rank, score)``, ties by id.

    The clauses of a query are a ``group``, and groups may hold groups. A document must match every ``must`` clause, no ``must_not`` clause and, when there is no
    ``must`` clause, at least one other. Scores of matched clauses add up. ``compact_norms``
    scores with field lengths cut to a one-byte norm.
    """
    literal, patterns, trees = _plan(index, queries, field)
    grouped = any(c.kind == "group" for clauses in queries.values() for c in clauses)
    # A query of one clause has one hit per document already, so nothing needs to be summed.
    units = {(r[0], r[1]) for r in literal} | {row[:2] for row, _ in patterns}
    excludes = any(r[3] == "must_not" for r in literal) or any(c.occur == "must_not" for _, c in patterns)
    lone = not grouped and not excludes and len(units) == len({q for q, _ in units})
    weights = _weights(index, literal)
    parts = []
    wanted = _any_of([(F.col("field") == f) & F.col("term").isin(sorted(ts)) for f, ts in _terms_by_field(literal)]) if literal else None
    matching = index.matching
    if index.rows is not None and literal and patterns:
        # Texts are analysed once for both kinds of clauses.
        both = _any_of([wanted, *((F.col("field") == c.field) & _term_test(c) for _, c in patterns)])
        matching = staged(index.matching(both), "matched").filter
    if weights is not None:
        length = X.compact_length(F.col("doc_len")) if compact_norms else F.col("doc_len")
        # One row per typed token at most, since terms are unique: small by construction.
        rows = matching(wanted).join(F.broadcast(weights), ["field", "term"])
        rows = rows.withColumn("_len", length)
        keys = ["query_id", "clause", "occur", "need", "doc_id"]

        def bm25(freq: Column) -> Column:
            return F.col("boost") * F.col("idf") * X.bm25_tf(freq, F.col("_len"), F.col("avg_len"), k1, b)

        if any(r[2] == "match" for r in literal):
            single = rows.filter(F.col("kind") == "match")
            parts.append(single.select(*keys, bm25(F.col("tf")).alias("score")))
        if any(r[2] == "phrase" for r in literal):
            # Each term's positions, moved back to where the phrase would start; a document's
            # phrase frequency is the number of starts that all its terms agree on.
            starts = F.transform("positions", lambda p: p - F.col("offset"))
            at = rows.filter(F.col("kind") == "phrase").withColumn("starts", starts)
            lists = at.groupBy(*keys, "boost", "_len", "avg_len", "n_terms").agg(
                F.collect_list("starts").alias("lists"), F.sum("idf").alias("idf")
            )
            common = F.aggregate("lists", F.get("lists", F.lit(0)), lambda a, x: F.array_intersect(a, x))
            whole = lists.filter(F.size("lists") == F.col("n_terms")).withColumn("freq", F.size(common))
            freq = whole.filter("freq > 0")
            parts.append(freq.select(*keys, bm25(F.col("freq")).alias("score")))
    looked_up = [p for p in patterns if p[1].kind in ("wildcard", "fuzzy")] if index.rows is None else []
    if looked_up:
        patterns = [p for p in patterns if p not in looked_up]
        parts.append(_once(_expanded(index, looked_up)))
    if patterns:
        tests = [(row, (F.col("field") == c.field) & _term_test(c)) for row, c in patterns]
        rows = matching(_any_of([t for _, t in tests])).select("field", "term", "doc_id")
        hit = F.array_compact(
            F.array(
                *(
                    F.when(
                        test,
                        F.struct(
                            F.lit(query_id).alias("query_id"),
                            F.lit(clause).alias("clause"),
                            F.lit(c.occur).alias("occur"),
                            F.lit(need).alias("need"),
                            F.lit(float(c.boost)).alias("score"),
                        ),
                    )
                    for ((query_id, clause, need), test), (_, c) in zip(tests, patterns, strict=True)
                )
            )
        )
        parts.append(_once(rows.select("doc_id", F.explode(hit).alias("hit")).select("hit.*", "doc_id")))
    if not parts:
        raise ValueError("no query holds a clause that can match")
    hits = reduce(DataFrame.unionByName, parts)
    if grouped:
        hits = _evaluated(hits, trees)
    elif not lone:
        hits = _combined(hits)
    # Sums arrive in any order; single floats keep equal documents equal, so ties go by id, and
    # unlike a fixed number of decimals they tell scores apart however small those are.
    scored = hits.select("query_id", "doc_id", F.col("score").cast("float").cast("double").alias("score"))
    ranked = top_k(scored, n, ["query_id"], [F.col("score").desc(), F.col("doc_id").asc()])
    return small(ranked.select("query_id", "doc_id", "rank", "score"), len(queries) * n)


def _once(hits: DataFrame) -> DataFrame:
    """A document that holds several matching terms matches the clause once."""
    return hits.groupBy("query_id", "clause", "occur", "need", "doc_id").agg(F.max("score").alias("score"))


def _expanded(index: TextIndex, patterns: list) -> DataFrame:
    """Hits of wildcard and fuzzy clauses: the terms they match are looked up, then joined.

    Stored forms narrow the terms down to a few row groups; without them the lexicon is read once.
    Either way the clauses are tested on the terms themselves. The terms found are a table, sent to
    the postings if it is small; as literals or, beyond that, as a range they also prune the scan.
    """
    clauses = [c for _, c in patterns]
    tests = [(F.col("field") == c.field) & _term_test(c) for c in clauses]
    if index.forms is not None:
        near = _any_of([(F.col("field") == c.field) & _form_test(c) for c in clauses])
        words = index.forms.filter(near).select("field", "term").distinct()
    else:
        words = index.lexicon.filter((F.col("term") != FIELD_TOTALS) & _any_of(tests)).select("field", "term")
    matching = F.array_compact(F.array(*(F.when(test, F.lit(i)) for i, test in enumerate(tests))))
    found = staged(words.select("field", "term", F.explode(matching).alias("i")), "terms")
    kind = "string" if isinstance(patterns[0][0][0], str) else "long"
    asked = [(i, q, clause, c.occur, need, float(c.boost)) for i, ((q, clause, need), c) in enumerate(patterns)]
    schema = f"i int, query_id {kind}, clause int, occur string, need int, score double"
    # One row per clause.
    found = found.join(F.broadcast(index.postings.sparkSession.createDataFrame(asked, schema)), "i").drop("i")
    seen = found.agg(F.count("*").alias("n"), F.min("term").alias("low"), F.max("term").alias("high")).first()
    if seen["n"] <= _EXPANSIONS:
        rows = index.postings.filter(F.col("term").isin([r["term"] for r in found.select("term").distinct().collect()]))
    else:
        rows = index.postings.filter(F.col("term").between(seen["low"], seen["high"]))
    return rows.select("field", "term", "doc_id").join(small(found, seen["n"], 512), ["field", "term"]).drop("field", "term")


def _combined(hits: DataFrame) -> DataFrame:
    """Clause hits to the documents that satisfy their query, with the sum of the scores."""
    merged = hits.groupBy("query_id", "doc_id").agg(
        F.sum(F.when(F.col("occur") != "must_not", F.col("score")).otherwise(0.0)).alias("score"),
        F.count_if(F.col("occur") == "must").alias("_must"),
        F.count_if(F.col("occur") == "should").alias("_should"),
        F.count_if(F.col("occur") == "must_not").alias("_not"),
        F.max("need").alias("_need"),
    )
    return merged.filter("_not = 0 AND _must = _need AND (_need > 0 OR _should > 0)")


@dataclass(frozen=True)
class _Node:
    """A clause in the tree of its query: a number of the query's hits, or a group of nodes."""

    occur: str
    clause: int | None = None
    parts: tuple[_Node, ...] = ()
    at_least: int | None = None
    boost: float = 1.0

    def size(self) -> int:
        return 1 if self.clause is not None else sum(p.size() for p in self.parts)


def _evaluated(hits: DataFrame, trees: Mapping[object, _Node]) -> DataFrame:
    """Clause hits to the documents whose query's tree is true, with the tree's score.

    One aggregation turns the hits of a document into a row with a column per clause; the trees are
    then expressions over it, evaluated from the leaves up.
    """
    width = max(t.size() for t in trees.values())
    columns = [F.max(F.when(F.col("clause") == i, F.col("score"))).alias(f"_s{i}") for i in range(width)]
    rows = hits.groupBy("query_id", "doc_id").agg(*columns)
    values = {q: _value(t) for q, t in trees.items()}
    ok = reduce(lambda a, q: a.when(F.col("query_id") == q, values[q][0]), trees, F)
    score = reduce(lambda a, q: a.when(F.col("query_id") == q, values[q][1]), trees, F)
    return rows.filter(ok.otherwise(False)).withColumn("score", score).select("query_id", "doc_id", "score")


def _value(node: _Node) -> tuple[Column, Column]:
    """Whether a node matches, and its score where it does."""
    if node.clause is not None:
        hit = F.col(f"_s{node.clause}")
        return hit.isNotNull(), F.coalesce(hit, F.lit(0.0))
    parts = [(p.occur, *_value(p)) for p in node.parts]
    of = lambda occur: [ok for o, ok, _ in parts if o == occur]
    musts, shoulds, nots = of("must"), of("should"), of("must_not")
    least = node.at_least if node.at_least is not None else (0 if musts else 1)
    met = sum((ok.cast("int") for ok in shoulds), F.lit(0)) >= least
    ok = reduce(lambda a, b: a & b, [met, *musts, *(~x for x in nots)]) if musts or shoulds else F.lit(False)
    total = sum((F.when(ok, score).otherwise(0.0) for o, ok, score in parts if o != "must_not"), F.lit(0.0))
    return ok, total * node.boost


def _any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _terms_by_field(literal: Sequence[tuple]) -> list[tuple[str, set[str]]]:
    by_field: dict[str, set[str]] = {}
    for row in literal:
        by_field.setdefault(row[5], set()).add(row[6])
    return sorted(by_field.items())


def _plan(index: TextIndex, queries: Mapping[object, Sequence[Clause]], field: str):
    """Analysed clauses: one row per typed token, the pattern clauses, and the tree of each query.

    Clauses that hit are numbered from 0 within their query, every token of a ``match`` being one.
    """

    def leaves(c: Clause) -> Iterator[Clause]:
        for part in c.parts if c.kind == "group" else (c,):
            yield from leaves(part) if part.kind == "group" else (part,)

    flat = [(q, replace(leaf, field=leaf.field or field)) for q, clauses in queries.items() for c in clauses for leaf in leaves(c)]
    if not flat:
        raise ValueError("no clauses")
    spark = index.postings.sparkSession
    texts = spark.createDataFrame([(i, c.text) for i, (_, c) in enumerate(flat)], "i int, text string")
    tokens = {r["i"]: r["tokens"] for r in texts.select("i", X.tokenize(F.col("text")).alias("tokens")).collect()}
    units: dict[object, list[tuple[Clause, list[str]]]] = {q: [] for q in queries}
    following = iter(enumerate(flat))

    def nodes(c: Clause) -> list[_Node]:
        if c.kind == "group":
            return [_Node(c.occur, None, tuple(n for p in c.parts for n in nodes(p)), c.at_least, c.boost)]
        i, (q, c) = next(following)
        if c.kind == "match" and c.occur != "should" and len(tokens[i]) > 1:
            raise ValueError("a must or must_not match clause takes one token; use phrase or several clauses")
        if c.kind == "match":
            own = [[t] for t in tokens[i]]
        else:
            own = [tokens[i] if c.kind == "phrase" else []] if tokens[i] or c.kind != "phrase" else []
        first = len(units[q])
        units[q] += [(c, terms) for terms in own]
        return [_Node(c.occur, first + k) for k in range(len(own))]

    trees = {q: _Node("should", None, tuple(n for c in clauses for n in nodes(c))) for q, clauses in queries.items()}
    literal, patterns = [], []
    for q, own in units.items():
        need = sum(c.occur == "must" for c, _ in own)
        for clause, (c, terms) in enumerate(own):
            if c.kind not in ("match", "phrase"):
                patterns.append(((q, clause, need), c))
            for offset, term in enumerate(terms):
                literal.append((q, clause, c.kind, c.occur, need, c.field, term, offset, len(terms), float(c.boost)))
    return literal, patterns, trees


def _weights(index: TextIndex, literal: Sequence[tuple]) -> DataFrame | None:
    """Typed tokens with the idf of their term and the mean length of their field."""
    if not literal:
        return None
    spark = index.postings.sparkSession
    kind = "string" if isinstance(literal[0][0], str) else "long"
    typed = spark.createDataFrame(
        list(literal),
        f"query_id {kind}, clause int, kind string, occur string, need int, field string, term string, "
        "offset int, n_terms int, boost double",
    )
    # Few rows: one per typed term and field, so the window over a field is small.
    fields = _terms_by_field(literal)
    wanted = _any_of([(F.col("field") == f) & F.col("term").isin([FIELD_TOTALS, *sorted(ts)]) for f, ts in fields])
    totals = F.when(F.col("term") == FIELD_TOTALS, F.struct("n_docs", "n_tokens"))
    known = index.lexicon.filter(wanted).withColumn("all", F.max(totals).over(Window.partitionBy("field")))
    weighed = known.select(
        "field",
        "term",
        X.bm25_idf(F.col("all.n_docs"), F.col("n_docs")).alias("idf"),
        (F.col("all.n_tokens") / F.col("all.n_docs")).alias("avg_len"),
    )
    return typed.join(weighed, ["field", "term"])
