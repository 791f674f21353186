"""Data quality: rules give findings, findings give decisions, an audit and a gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import blank
from .media import picture_check

IDS = ("sample_id", "relation_id", "asset_id")
FINDING = "reason_code string, severity string, scope string, decision_hint string, dataset_name string, message string, sample_id string, relation_id string, asset_id string, metadata map<string,string>"

# Reason code, severity, scope, decision hint.
REASONS = {
    "schema_required_field_missing": ("error", "sample", "block"),
    "schema_modality_constraint_failed": ("error", "sample", "block"),
    "empty_text": ("error", "sample", "drop"),
    "broken_media": ("error", "asset", "quarantine"),
    "missing_reference": ("error", "sample", "block"),
    "id_collision": ("error", "sample", "block"),
    "empty_qrels": ("error", "relation", "block"),
    "missing_query_link": ("error", "relation", "block"),
    "missing_candidate_link": ("error", "relation", "block"),
    "invalid_positive": ("error", "relation", "block"),
    "invalid_identifier": ("error", "sample", "block"),
    "relation_cardinality_mismatch": ("error", "relation", "block"),
}
# The action of each hint, and the order in which actions outdo each other.
ACTIONS = {"keep": "keep", "drop": "drop", "quarantine": "quarantine", "block": "quarantine"}
PRIORITY = ("keep", "drop", "quarantine")
BLOCKING = ("block", "drop", "quarantine")
TARGETS = ("dataset", "sample", "relation", "asset")
# Text fields that training documents must have, by loader.
DOCUMENT_FIELDS = {"vidore_train": ("query", "answer", "source"), "vidore_rag_train": ("query", "answer", "source"), "visrag_train": ("query", "source")}
MAGIC = (b"\xff\xd8\xff", b"\x89PNG", b"GIF8", b"RIFF", b"BM")


def reasons(spark) -> DataFrame:
    """The reason codes as a table of twelve rows."""
    return spark.createDataFrame([(k, *v) for k, v in REASONS.items()], "reason_code string, severity string, scope string, decision_hint string")


def findings(df: DataFrame, reason: str, dataset: str, message: Column, ids: Mapping[str, Column | str] | None = None, metadata: Mapping[str, Column] | None = None) -> DataFrame:
    """A finding for each row of df. Ids that are blank count as absent; ids names those of IDS that the rows have."""
    severity, scope, hint = REASONS[reason]
    held = {}
    for name in IDS:
        value = (ids or {}).get(name)
        value = F.lit(None) if value is None or (isinstance(value, str) and value not in df.columns) else F.col(value) if isinstance(value, str) else value
        value = value.cast("string")
        held[name] = F.when(value != "", value)
    pairs = [x for k, v in (metadata or {}).items() for x in (F.lit(k), v.cast("string"))]
    notes = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    fixed = [F.lit(x).alias(n) for x, n in ((reason, "reason_code"), (severity, "severity"), (scope, "scope"), (hint, "decision_hint"), (dataset, "dataset_name"))]
    return df.select(*fixed, message.alias("message"), *[v.alias(k) for k, v in held.items()], notes.alias("metadata"))


def _items(df: DataFrame, column: str) -> Column:
    """The values of a column, single or in an array, as an array."""
    kind = dict(df.dtypes)[column]
    empty = f"array<{kind}>"
    return F.coalesce(F.col(column), F.array().cast(kind)) if kind.startswith("array") else F.when(F.col(column).isNotNull(), F.array(column)).otherwise(F.array().cast(empty))


def _texts(df: DataFrame, column: str) -> Column:
    return F.transform(_items(df, column), lambda x: x.cast("string"))


def required_fields(df: DataFrame, fields: Sequence[str], dataset: str, sample: str = "sample_id") -> DataFrame:
    """A finding for each field that is null, or a blank text; all fields in one pass."""
    kinds = dict(df.dtypes)
    lacks = [F.when(blank(F.col(f)) if kinds[f] == "string" else F.col(f).isNull(), F.lit(f)) for f in fields]
    absent = F.explode(F.filter(F.array(*lacks), lambda x: x.isNotNull())).alias("__field")
    rows = df.select(*[c for c in (sample,) if c in df.columns], absent)
    return findings(rows, "schema_required_field_missing", dataset, F.concat(F.lit("Missing required field: "), F.col("__field")), {"sample_id": sample}, {"field": F.col("__field")})


def duplicate_ids(df: DataFrame, key: str, order: Sequence[str], dataset: str, sample: str = "sample_id") -> DataFrame:
    """A finding for each occurrence after the first by order; null and empty ids don't count."""
    text = F.col(key).cast("string")
    seen = df.where(F.coalesce(text, F.lit("")) != "").withColumn("__n", F.row_number().over(W.partitionBy(text).orderBy(*order)))
    return findings(seen.where("__n > 1"), "id_collision", dataset, F.concat(F.lit(f"Duplicate identifier detected in {key}: "), text), {"sample_id": sample}, {"field": F.lit(key), "value": text})


def empty_text(df: DataFrame, text: str, dataset: str, sample: str = "sample_id") -> DataFrame:
    return findings(df.where(blank(F.col(text))), "empty_text", dataset, F.lit(f"Empty text payload in field {text}"), {"sample_id": sample}, {"field": F.lit(text)})


def no_modality(df: DataFrame, dataset: str, text: str = "text", images: str = "images", image: str = "image", sample: str = "sample_id") -> DataFrame:
    """Rows with neither a text that isn't blank nor any picture; columns that are absent count as null."""
    has = F.lit(False)
    if text in df.columns:
        has = has | ~blank(F.col(text))
    if images in df.columns:
        has = has | (F.size(F.coalesce(F.col(images), F.array().cast(dict(df.dtypes)[images]))) > 0)
    if image in df.columns:
        has = has | F.col(image).isNotNull()
    return findings(df.where(~has), "schema_modality_constraint_failed", dataset, F.lit("Row has neither usable text nor media payload."), {"sample_id": sample})


def dangling(df: DataFrame, reference: str, referred: DataFrame, key: str, dataset: str, relation: str = "relation_id") -> DataFrame:
    """References, single or in an array, that no key answers; compared as text."""
    held = [c for c in (relation,) if c in df.columns]
    refs = df.select(*held, F.explode(_texts(df, reference)).alias("__ref")).where("__ref IS NOT NULL")
    lost = refs.join(referred.select(F.col(key).cast("string").alias("__ref")).distinct(), "__ref", "left_anti")
    return findings(lost, "missing_reference", dataset, F.concat(F.lit(f"Missing linked reference in {reference}: "), F.col("__ref")), {"relation_id": relation}, {"field": F.lit(reference), "missing_id": F.col("__ref")})


def prefix(df: DataFrame, field: str, expected: str, dataset: str, relation: str | None = None) -> DataFrame:
    """Identifiers, single or in an array, that don't begin as they should; null and empty ones don't count."""
    held = [c for c in (relation,) if c]
    items = df.select(*held, F.explode(_texts(df, field)).alias("__item"))
    wrong = items.where((F.col("__item") != "") & ~F.startswith("__item", F.lit(expected)))
    message = F.concat(F.lit(f"Field '{field}' must start with '{expected}', got '"), F.col("__item"), F.lit("'."))
    return findings(wrong, "invalid_identifier", dataset, message, {"relation_id": relation} if relation else {}, {"field_name": F.lit(field), "value": F.col("__item"), "expected_prefix": F.lit(expected)})


def cardinality(qrels: DataFrame, dataset: str, ids: str = "candidate_ids", scores: str = "candidate_scores", relation: str = "relation_id") -> DataFrame:
    a, b = (F.size(F.coalesce(F.col(c), F.array().cast(dict(qrels.dtypes)[c]))) for c in (ids, scores))
    message = F.concat(F.lit("Qrels row has mismatched candidate_ids and candidate_scores lengths: "), a.cast("string"), F.lit(" != "), b.cast("string"))
    return findings(qrels.where(a != b), "relation_cardinality_mismatch", dataset, message, {"relation_id": relation}, {"candidate_count": a, "score_count": b})


def broken_media(df: DataFrame, dataset: str, images: str = "images", image: str = "image", sample: str = "sample_id", assets: str = "asset_ids", magic: Sequence[bytes] = MAGIC, whole: bool = False) -> DataFrame:
    """Byte fields that start like no known picture, with their place; the single field counts where the array is empty, nulls don't.

    whole: pictures are walked through to their end, and the message says what is wrong.
    """
    many = _items(df, images) if images in df.columns else F.array().cast("array<binary>")
    one = _items(df, image) if image in df.columns else F.array().cast("array<binary>")
    held = [c for c in (sample, assets) if c in df.columns]
    rows = df.select(*held, F.when(F.size(many) > 0, many).otherwise(one).alias("__media")).select(*held, F.posexplode("__media").alias("__at", "__m"))
    rows = rows.withColumn("__m", F.col("__m").cast("binary")).where("__m IS NOT NULL")
    known = reduce(lambda x, y: x | y, [F.hex(F.substring("__m", 1, len(m))) == m.hex().upper() for m in magic])
    asset = F.get(assets, F.col("__at")) if assets in held else F.lit(None)
    message = F.concat(F.lit("Unreadable media payload at index "), F.col("__at").cast("string"))
    if whole:
        rows = rows.withColumn("__check", picture_check(F.col("__m")))
        known, message = F.col("__check.reason").isNull(), F.concat(message, F.lit(": "), F.col("__check.error"))
    return findings(rows.where(~known), "broken_media", dataset, message, {"sample_id": sample, "asset_id": asset}, {"field": F.lit(images), "index": F.col("__at")})


def retrieval_integrity(queries: DataFrame, candidates: DataFrame, qrels: DataFrame, dataset: str, relation: str = "relation_id") -> DataFrame:
    """What is wrong with qrels: none at all (then nothing else), an unknown query, no candidates
    (then nothing else of the row), unknown candidates, no score above zero."""
    text = lambda df, c: df.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("__key")).distinct()
    ids = {"relation_id": relation}
    none = qrels.agg(F.count(F.lit(1)).alias("__n")).where("__n = 0")
    parts = [findings(none, "empty_qrels", dataset, F.lit("Retrieval dataset has no qrels rows."))]
    asked = qrels.select(relation, F.coalesce(F.col("query_id").cast("string"), F.lit("None")).alias("__key"))
    lost = asked.join(text(queries, "id"), "__key", "left_anti")
    parts.append(findings(lost, "missing_query_link", dataset, F.concat(F.lit("Qrels references missing query: "), F.col("__key")), ids, {"query_id": F.col("__key")}))
    rows = qrels.select(relation, _items(qrels, "candidate_ids").alias("__ids"), _items(qrels, "candidate_scores").alias("__scores"))
    parts.append(findings(rows.where(F.size("__ids") == 0), "empty_qrels", dataset, F.lit("Qrels row contains no candidate ids."), ids))
    rows = rows.where(F.size("__ids") > 0)
    named = rows.select(relation, F.explode(F.transform("__ids", lambda x: x.cast("string"))).alias("__key"))
    lost = named.withColumn("__key", F.coalesce("__key", F.lit("None"))).join(text(candidates, "id"), "__key", "left_anti")
    parts.append(findings(lost, "missing_candidate_link", dataset, F.concat(F.lit("Qrels references missing candidate: "), F.col("__key")), ids, {"candidate_id": F.col("__key")}))
    unwanted = rows.where(~F.exists("__scores", lambda s: F.coalesce(s > 0, F.lit(False))))
    parts.append(findings(unwanted, "invalid_positive", dataset, F.lit("Qrels row contains no positive candidate score."), ids))
    return reduce(DataFrame.unionByName, parts)


def bundle(queries: DataFrame, candidates: DataFrame, qrels: DataFrame, dataset: str, order: Sequence[str] = ("id",)) -> DataFrame:
    """All findings of a retrieval bundle, with the ordinal of the check that made each: checks come in a fixed order."""
    both = (queries, candidates)
    checks = [
        *[required_fields(x, ("id",), dataset) for x in both],
        *[duplicate_ids(x, "id", order, dataset) for x in both],
        *[prefix(x, "sample_id", "sample_", dataset) for x in both],
        *[prefix(x, "asset_ids", "asset_", dataset) for x in both],
        prefix(qrels, "relation_id", "relation_", dataset, "relation_id"),
        cardinality(qrels, dataset),
        *[no_modality(x, dataset) for x in both],
        *[broken_media(x, dataset) for x in both],
        retrieval_integrity(queries, candidates, qrels, dataset),
    ]
    return reduce(DataFrame.unionByName, [c.withColumn("check", F.lit(k)) for k, c in enumerate(checks)])


def train_documents(rows: DataFrame, loader: str, dataset: str, order: Sequence[str], media_rows: int = 64) -> DataFrame:
    """Findings of a training table of documents: its loader's text fields in every row, pictures of the first media_rows rows.

    Rows count from 1 by order. The picture check of a few first rows is what this validator is: a cheap look before training.
    """
    if loader not in DOCUMENT_FIELDS:
        raise ValueError(f"unsupported loader type: {loader}")
    fields = DOCUMENT_FIELDS[loader]
    empty = rows.agg(F.count(F.lit(1)).alias("__n")).where("__n = 0")
    parts = [findings(empty, "schema_required_field_missing", dataset, F.lit("Training dataset contains no rows."), metadata={"field": F.lit("train_rows")})]
    key = F.concat(F.lit("sample_row_"), F.concat_ws("_", *[F.col(c).cast("string") for c in order]))
    keyed = rows.withColumn("sample_id", key)
    for f in fields:
        parts.append(findings(keyed.where(F.col(f).isNull()), "schema_required_field_missing", dataset, F.lit(f"Missing required field: {f}"), {"sample_id": "sample_id"}, {"field": F.lit(f)}))
        parts.append(empty_text(keyed.where(F.col(f).isNotNull()), f, dataset))
    first = keyed.orderBy(*order).limit(media_rows)
    parts.append(findings(first.where("image IS NULL"), "schema_required_field_missing", dataset, F.lit("Missing required field: image"), {"sample_id": "sample_id"}, {"field": F.lit("image")}))
    parts.append(broken_media(first.select("sample_id", "image"), dataset))
    return reduce(DataFrame.unionByName, parts)


def by_reason(found: DataFrame) -> DataFrame:
    return found.groupBy("reason_code").agg(F.count(F.lit(1)).alias("n"))


def targets(found: DataFrame) -> DataFrame:
    """found with target_type and target_id: the asset, else the relation, the sample, the dataset."""
    kind = F.when(F.col("asset_id").isNotNull(), "asset").when(F.col("relation_id").isNotNull(), "relation").when(F.col("sample_id").isNotNull(), "sample").otherwise("dataset")
    return found.withColumn("target_type", kind).withColumn("target_id", F.coalesce("asset_id", "relation_id", "sample_id", "dataset_name"))


def decisions(found: DataFrame) -> DataFrame:
    """One row per target: the gravest action, its reasons and messages in order, how many findings."""
    action = F.element_at(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv]), F.col("decision_hint"))
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), action)
    grouped = targets(found).groupBy("dataset_name", "target_type", "target_id")
    return grouped.agg(F.max_by(action, rank).alias("action"), F.array_sort(F.collect_set("reason_code")).alias("reasons"), F.count(F.lit(1)).alias("n_findings"), F.array_sort(F.collect_list("message")).alias("messages"))


def is_blocking() -> Column:
    return (F.col("severity") == "error") & F.col("decision_hint").isin(*BLOCKING)


def audit(found: DataFrame, first: int = 5, order: Sequence[str] = ("reason_code", "message", "sample_id", "relation_id", "asset_id")) -> DataFrame:
    """One row: how many findings, whether any blocks, whether the data is ready, counts by reason and the first findings.

    Only reasons and the first few findings by order are gathered.
    """
    head = found.orderBy(*order).limit(first).agg(F.array_sort(F.collect_list(F.struct("reason_code", "message", "sample_id", "relation_id", "asset_id"))).alias("representative"))
    by_code = found.groupBy("reason_code").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or(is_blocking()), F.lit(False)).alias("blocks"))
    whole = by_code.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_findings"), F.coalesce(F.bool_or("blocks"), F.lit(False)).alias("blocking"), F.array_sort(F.collect_list(F.struct("reason_code", "n"))).alias("reason_counts"))
    return whole.crossJoin(F.broadcast(head)).withColumn("ready", ~F.col("blocking"))  # one row by one row


def report(audited: DataFrame, decided: DataFrame, dataset: str) -> str:
    """The audit as Markdown; reads its one row and the counts by action."""
    row = audited.first()
    counts = {r[0]: r[1] for r in decided.groupBy("action").count().collect()}
    said = lambda x: "yes" if x else "no"
    ready = row["ready"] and not counts.get("drop") and not counts.get("quarantine")
    lines = [f"# Quality Report: {dataset}", "", f"- Ready: {said(ready)}", f"- Finding count: {row['n_findings']}", f"- Blocking findings: {said(row['blocking'])}"]
    lines += [f"- Keep / Drop / Quarantine: {' / '.join(str(counts.get(a, 0)) for a in PRIORITY)}", "", "## Reason Counts"]
    lines += [f"- `{r['reason_code']}`: {r['n']}" for r in row["reason_counts"]] or ["- None"]
    lines += ["", "## Representative Findings"] + ([f"- `{r['reason_code']}`: {r['message']}" for r in row["representative"]] or ["- None"])
    return "\n".join(lines) + "\n"


def buckets(decided: DataFrame) -> DataFrame:
    """How many targets of each action and type, empty cells included."""
    grid = decided.sparkSession.createDataFrame([(a, t) for a in PRIORITY for t in TARGETS], "action string, target_type string")
    return grid.join(decided.groupBy("action", "target_type").agg(F.count(F.lit(1)).alias("n")), ["action", "target_type"], "left").select("action", "target_type", F.coalesce("n", F.lit(0)).alias("n"))


def to_json(found: DataFrame) -> DataFrame:
    """A line for each finding."""
    return found.select(F.to_json(F.struct(*[F.col(c.split()[0]) for c in FINDING.split(", ")])).alias("line"))


def from_json(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json("line", FINDING).alias("x")).select("x.*")


def gate(found: DataFrame, mode: str = "auto", audited: DataFrame | None = None) -> DataFrame:
    """found, once it may pass. off asks nothing; an audit that is there decides in all other modes; without one, light
    passes, and full and auto raise if a finding blocks."""
    if mode not in ("off", "light", "full", "auto"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "off" or (mode == "light" and audited is None):
        return found
    row = (audit(found) if audited is None else audited).first()
    if not row["ready"]:
        raise ValueError("quality gate: " + (", ".join(f"{r['reason_code']}={r['n']}" for r in row["reason_counts"]) or "the audit says not ready"))
    return found
