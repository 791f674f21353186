"""Raw source tables to training rows and retrieval bundles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dedup, exclude, lookup, qrels

# Extensions of files that count as videos.
VIDEOS = (".mp4", ".mkv", ".webm", ".avi", ".mov", ".m4v", ".flv", ".wmv", ".mpg", ".mpeg")


def _none(rows: DataFrame, what: str) -> None:
    found = rows.limit(10).collect()
    if found:
        raise ValueError(f"{what}: {sorted(map(str, (r[0] for r in found)))}")


def beir_bundle(queries: DataFrame, corpus: DataFrame, judged: DataFrame, order: Sequence[str] = ("corpus-id",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, candidates, qrels) of BEIR tables.

    Judgments are grouped by query in the given order, further columns as arrays
    that join the query. Null or repeated ids, judgments of unknown rows, queries
    without judgments, candidates without a picture and clashing names raise.
    """
    for df, key in ((queries, "query-id"), (corpus, "corpus-id")):
        _none(df.where(F.col(key).isNull()).select(key), f"null {key}")
        _none(dedup.duplicate_keys(df, key).select(key), f"duplicate {key}")
        _none(judged.select(key).distinct().join(df.select(key), key, "left_anti"), f"unknown {key}")
    _none(queries.select("query-id").join(judged.select("query-id").distinct(), "query-id", "left_anti"), "queries without judgments")
    _none(corpus.where("image.bytes IS NULL").select("corpus-id"), "candidates without a picture")
    extras = [c for c in judged.columns if c not in ("query-id", "corpus-id", "score")]
    clash = set(extras) & set(queries.columns)
    if clash:
        raise ValueError(f"column names collide: {sorted(clash)}")
    most = judged.groupBy("query-id").count().agg(F.max("count")).first()[0] or 0
    group = qrels.group_large if most > qrels.RUN else qrels.group_pairs
    grouped = group(judged.withColumn("score", F.col("score").cast("double")), "query-id", "corpus-id", "score", order, extras)
    table = grouped.select("query_id", F.lit("sparse").alias("mode"), "candidate_ids", "candidate_scores")
    asked = queries.withColumnRenamed("query-id", "id").join(grouped.select(F.col("query_id").alias("id"), *extras), "id")
    rest = [c for c in corpus.columns if c not in ("corpus-id", "image")]
    held = corpus.select(F.col("corpus-id").alias("id"), F.col("image.bytes").alias("image"), F.col("image.path").alias("path"), *rest)
    return asked, held, table


def tagged_splits(lines: DataFrame, class_name: Column) -> DataFrame:
    """class, file, split of lines `file tag` (column value): tag 1 is train, 2 is test, 0 is left out, any other raises."""
    parts = F.split(F.trim("value"), r"\s+")
    tag = F.get(parts, F.lit(1))
    fail = F.raise_error(F.concat(F.lit("bad line: "), F.col("value")))
    split = F.when(tag == "1", "train").when(tag == "2", "test").when(tag == "0", F.lit(None)).otherwise(fail)
    rows = lines.where(F.trim("value") != "").select(class_name.alias("class"), F.get(parts, F.lit(0)).alias("file"), split.alias("split"))
    return rows.where("split IS NOT NULL")


def segments(rows: DataFrame, arrays: dict[str, str], video: str = "video", start: str = "start", end: str = "end") -> DataFrame:
    """A row for each element of parallel arrays ({new name: array}), with its place and segment key; unequal lengths raise."""
    names = list(arrays)
    sizes = [F.size(arrays[n]) for n in names]
    same = F.lit(True)
    for s in sizes[1:]:
        same = same & (s == sizes[0])
    zipped = F.arrays_zip(*[F.col(arrays[n]).alias(n) for n in names])
    checked = F.when(same, zipped).otherwise(F.raise_error(F.lit("parallel arrays of unequal lengths")))
    kept = [c for c in rows.columns if c not in arrays.values()]
    flat = rows.select(*kept, F.posexplode(checked).alias("segment", "x"))
    flat = flat.select(*kept, "segment", *[F.col("x")[n].alias(n) for n in names])
    return flat.withColumn("frame_unit_key", text.segment_key(F.col(video), F.col(start), F.col(end)))


def highlight_keys(rows: DataFrame) -> DataFrame:
    """rows (vid, relevant_windows) with the keys of the whole video and of each window."""
    windows = F.coalesce("relevant_windows", F.array().cast("array<array<float>>"))
    keys = F.transform(windows, lambda w: text.segment_key(F.col("vid"), F.get(w, F.lit(0)), F.get(w, F.lit(1))))
    return rows.withColumn("query_frame_unit_key", text.segment_key(F.col("vid"))).withColumn("positive_frame_unit_keys", keys)


def positive_passages(rows: DataFrame) -> DataFrame:
    """A row for each positive passage with its rank; negatives stay as JSON, missing titles and texts are empty."""
    flat = rows.select("query_id", F.trim("query").alias("query"), "answers", F.to_json("negative_passages").alias("negative_passages_json"), F.posexplode("positive_passages").alias("positive_rank", "p"))
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return flat.select("query_id", "query", "answers", "positive_rank", F.col("p.docid").alias("positive_docid"), empty("p.title").alias("positive_title"), empty("p.text").alias("positive_text"), "negative_passages_json")


def without_eval_queries(samples: DataFrame, eval_queries: DataFrame, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """(kept, excluded) samples by query text; prefix: the prompt that evaluation queries may begin with."""
    x = F.col(eval_queries.columns[0])
    bare = F.when(F.startswith(x, F.lit(prefix)), F.substring(x, len(prefix) + 1, 1 << 30)).otherwise(x)
    keys = eval_queries.select(F.trim(bare).alias("query"))
    return exclude.exclude(samples, keys, "query"), exclude.excluded(samples, keys, "query")


def fixed_options(rows: DataFrame, options: str = "options", n: int = 5) -> DataFrame:
    """rows, once read each with exactly n options."""
    fail = F.raise_error(F.concat(F.lit(f"not {n} options: "), F.to_json(options)))
    return rows.withColumn(options, F.when(F.size(options) == n, F.col(options)).otherwise(fail))


def question_rows(rows: DataFrame, qa: str = "QA") -> DataFrame:
    """A row for each question and answer of a video, with its place."""
    kept = [c for c in rows.columns if c != qa]
    return rows.select(*kept, F.posexplode(qa).alias("qa_index", "x")).select(*kept, "qa_index", "x.*")


def decoded_only(rows: DataFrame, key: str, units: DataFrame) -> DataFrame:
    """Rows whose frame unit is there."""
    return rows.join(units.select(F.col("frame_unit_key").alias(key)).distinct(), key, "left_semi")


def without_empty_sides(rows: DataFrame, query: Sequence[str], positive: Sequence[str], strict: bool = False) -> DataFrame:
    """Rows whose query side and positive side each have something; null and the empty text are nothing. strict raises instead."""
    empty = lambda columns: F.coalesce(F.concat(*[F.coalesce(F.col(c), F.lit("")) for c in columns]), F.lit("")) == ""
    lacks = empty(query) | empty(positive)
    if strict:
        return rows.where(F.when(~lacks, F.lit(True)).otherwise(F.raise_error(F.lit("a side of a row is empty")).cast("boolean")))
    return rows.where(~lacks)


def single_evidence(rows: DataFrame, pages: str, document: str, documents: DataFrame) -> DataFrame:
    """rows with `page`, the one page that the JSON list of pages holds, and `reason`, why a row can't be used (else null).

    documents: one column, the documents that are there.
    """
    listed = F.from_json(pages, "array<int>")
    known = documents.toDF(document).distinct().withColumn("__there", F.lit(True))
    n = F.coalesce(F.size(listed), F.lit(0))
    reason = F.when(n < 1, "no page").when(n > 1, "several pages").when(F.get(listed, F.lit(0)).isNull(), "no page").when(F.col("__there").isNull(), "no document")
    return rows.join(known, document, "left").withColumn("reason", reason).withColumn("page", F.when(n == 1, F.get(listed, F.lit(0)))).drop("__there")


def trim_elements(rows: DataFrame, key: str, keys: str, parallel: Sequence[str], valid: DataFrame) -> DataFrame:
    """Arrays without the elements whose key isn't valid, parallel ones alike; rows with none left go. key names a row.

    valid: one column of keys, of any size.
    """
    names = [keys, *parallel]
    zipped = F.arrays_zip(*[F.col(c) for c in names])
    flat = rows.select(key, F.posexplode(zipped).alias("__at", "__x")).withColumn("__key", F.col("__x")[keys])
    kept = flat.join(valid.toDF("__key").distinct(), "__key", "left_semi")
    packed = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__at", *[F.col("__x")[c].alias(c) for c in names]))).alias("__p"))
    arrays = packed.select(key, *[F.col(f"__p.{c}").alias(c) for c in names])
    return rows.drop(*names).join(arrays, key).select(*rows.columns)


def real_candidates(candidates: Column, drop: bool = False) -> Column:
    """Candidates none of which is blank. A blank one raises; with drop it goes, unless it is the first, the positive."""
    lacks = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad = lacks(F.get(candidates, F.lit(0))) if drop else F.exists(candidates, lacks)
    return F.when(bad, F.raise_error(F.lit("blank candidate"))).otherwise(F.filter(candidates, lambda c: ~lacks(c)))


def video_files(files: DataFrame, path: str) -> DataFrame:
    return files.where(text.extension(F.col(path)).isin(*VIDEOS))


def guarded(train: DataFrame, evaluation: DataFrame, *on: str) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded) rows of a training split, by the keys of an evaluation split."""
    return exclude.exclude(train, evaluation, *on), exclude.excluded(train, evaluation, *on)


def candidate_pool(queries: DataFrame, pool: DataFrame, task: int, eval_queries: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, excluded, candidates) of one task: its queries with the text of the candidate they name first.

    queries: qid, query_txt, task_id, pos_cand_list; pool: did, txt. A query without
    candidates and a first candidate that the pool lacks raise when they are read.
    Candidates are those of the pool that some query names first.
    """
    own = queries.where(F.col("task_id") == task).select(F.col("qid").cast("string").alias("qid"), "query_txt", F.transform("pos_cand_list", lambda x: x.cast("string")).alias("pos_cand_list"))
    first = F.get("pos_cand_list", F.lit(0))
    own = own.withColumn("first_positive", F.coalesce(first, F.raise_error(F.concat(F.lit("no positive candidate: "), F.col("qid")))))
    side = pool.select(F.col("did").cast("string").alias("did"), "txt")
    keys = (eval_queries if eval_queries is not None else own.where("false")).select(F.col("qid").cast("string").alias("qid"))
    joined = lookup.lookup(own, lookup.Lookup(side, "first_positive", "did", {"txt": "positive_txt"}))
    joined = joined.withColumn("did", F.col("first_positive")).drop("first_positive")
    kept, gone = guarded(joined, keys, "qid")
    return kept, gone, side.join(own.select(F.col("first_positive").alias("did")).distinct(), "did", "left_semi")


def voted_answers(rows: DataFrame, key: str) -> DataFrame:
    """rows (answers: array of answer, answer_confidence; answerable) with selected_answer, null where no vote counts."""
    flat = rows.where("answerable").select(key, F.posexplode("answers").alias("__at", "__a"))
    flat = flat.select(key, "__at", F.col("__a.answer").alias("__answer"), dedup.confidence(F.col("__a.answer_confidence")).cast("long").alias("__weight"))
    won = dedup.weighted_vote(flat.withColumnRenamed("__answer", "answer"), key, "answer", "__weight", "__at")
    won = won.select(key, F.col("answer").alias("selected_answer"))
    return rows.join(won, key, "left")


def voted_rows(rows: DataFrame, key: str, eval_pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded) rows that are answerable and have an answer; pairs (question, answer) of an evaluation are excluded, as normalized."""
    voted = voted_answers(rows, key).where("answerable AND coalesce(selected_answer, '') <> ''")
    keys = eval_pairs.toDF("question", "selected_answer")
    return exclude.exclude_normalized(voted, keys, "question", "selected_answer"), exclude.excluded_normalized(voted, keys, "question", "selected_answer")


@dataclass(frozen=True)
class Samples:
    """How rows of a training source become samples.

    query: the body's column; instruction: by the value of `kind`, with a default;
    join: how instruction and body meet; lookups: side tables to extend rows by.
    """

    query: str
    default: str
    kind: str = ""
    instruction: Mapping[str, str] = field(default_factory=dict)
    join: str = "newline"
    lookups: Sequence[lookup.Lookup] = ()


def samples(rows: DataFrame, spec: Samples) -> DataFrame:
    """rows with the column query: the instruction of each row's kind and its body."""
    said = F.lit(spec.default)
    for name, instruction in spec.instruction.items():
        said = F.when(F.col(spec.kind) == name, instruction).otherwise(said)
    return lookup.lookup_chain(rows, list(spec.lookups)).withColumn("query", text.join_texts(said, F.col(spec.query), spec.join))
