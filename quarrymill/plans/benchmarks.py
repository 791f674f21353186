"""The benchmark: which datasets it has, and how the results of each add up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analytics import summary
from ..operators.staging import staged
from ..sources.files import _listed
from .retrieval import dataset_results, evaluate_each, parse_metrics

# Datasets by modality and task.
DATASETS = {
    ("image", "image_classification"): "VOC2007 N24News SUN397 ObjectNet Country211 Place365 ImageNet-1K HatefulMemes ImageNet-A ImageNet-R",
    ("image", "image_question_answer"): "OK-VQA A-OKVQA DocVQA InfographicsVQA ChartQA Visual7W ScienceQA GQA TextVQA VizWiz",
    ("image", "image_retrieval"): "VisDial CIRR VisualNews_t2i VisualNews_i2t MSCOCO_t2i MSCOCO_i2t NIGHTS WebQA FashionIQ Wiki-SS-NQ OVEN EDIS",
    ("image", "image_visual_grounding"): "MSCOCO RefCOCO RefCOCO-Matching Visual7W-Pointing",
    ("video", "video_classification"): "K700 UCF101 HMDB51 SmthSmthV2 Breakfast",
    ("video", "video_question_answer"): "Video-MME MVBench NExTQA EgoSchema ActivityNetQA",
    ("video", "video_retrieval"): "MSR-VTT MSVD DiDeMo VATEX YouCook2",
    ("video", "video_moment_retrieval"): "QVHighlight Charades-STA MomentSeeker",
    ("visdoc", "visdoc_vidore_v1"): "ViDoRe_arxivqa ViDoRe_docvqa ViDoRe_infovqa ViDoRe_tabfquad ViDoRe_tatdqa ViDoRe_shiftproject ViDoRe_syntheticDocQA_artificial_intelligence "
    "ViDoRe_syntheticDocQA_energy ViDoRe_syntheticDocQA_government_reports ViDoRe_syntheticDocQA_healthcare_industry",
    ("visdoc", "visdoc_vidore_v2"): "ViDoRe_esg_reports_human_labeled_v2 ViDoRe_biomedical_lectures_v2_multilingual ViDoRe_economics_reports_v2_multilingual ViDoRe_esg_reports_v2_multilingual",
    ("visdoc", "visdoc_visrag"): "VisRAG_ArxivQA VisRAG_ChartQA VisRAG_MP-DocVQA VisRAG_SlideVQA VisRAG_InfoVQA VisRAG_PlotQA",
    ("visdoc", "visdoc_ood"): "ViDoSeek-page ViDoSeek-doc MMLongBench-page MMLongBench-doc",
}
ARTIFACTS = ("queries", "candidates", "qrels", "metadata.json")


def rows() -> list[tuple[str, str, str, str]]:
    """(name, folder, modality, task) of each dataset."""
    return [(name, f"{modality}-tasks/{name}", modality, task) for (modality, task), names in DATASETS.items() for name in names.split()]


def index(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "dataset string, folder string, modality string, task_type string")


def discover(spark: SparkSession, root: str, only: Sequence[str] | None = None, metrics: Sequence[str] = (), wanted: Mapping[str, str] | None = None) -> list[tuple[str, str, str, str]]:
    """The datasets below root that are asked for, all by default; unknown names, and folders or artifacts that are missing, raise.

    wanted: the metric by which each modality is summed up; metrics must have them all.
    """
    known = {r[0]: r for r in rows()}
    unknown = sorted(set(only or ()) - set(known))
    if unknown:
        raise ValueError(f"unknown datasets: {unknown}")
    lacks = sorted(set((wanted or {}).values()) - set(metrics))
    if lacks:
        raise ValueError(f"metrics lack {lacks}")
    if metrics:
        parse_metrics(metrics)
    found = [r for r in known.values() if only is None or r[0] in only]
    gone = [f"{r[1]}/{a}" for r in found for a in ARTIFACTS if not _listed(spark, f"{root}/{r[1]}/{a}*")]
    if gone:
        raise FileNotFoundError(f"missing below {root}: {gone[:10]}")
    return found


def rollup(results: DataFrame, names: DataFrame, by_modality: Mapping[str, str]) -> DataFrame:
    """Means by task, modality and over all of results (dataset, metric, value); each modality counts by a metric of its own.

    A dataset that the index lacks raises.
    """
    joined = results.join(F.broadcast(names.select("dataset", "modality", "task_type")), "dataset", "left")  # a row for each dataset
    said = F.raise_error(F.concat(F.lit("unknown dataset "), F.col("dataset"))).cast("string")
    joined = joined.withColumn("modality", F.coalesce("modality", said))
    pick = F.create_map(*[F.lit(x) for kv in by_modality.items() for x in kv])
    counted = joined.where(F.col("metric") == F.try_element_at(pick, F.col("modality")))
    return summary(counted, "modality", "task_type", "value")


def run(queries: DataFrame, candidates: DataFrame, qrels: DataFrame, names: DataFrame, by_modality: Mapping[str, str], metrics: Sequence[str], skip_self: bool = False) -> DataFrame:
    """All datasets of names (dataset, modality, task_type) evaluated in one plan: dataset, metric, value, n.

    Beside the datasets' own rows there are those of `_summary`, `modality` and `modality/task_type`: the means of the
    metric by which each modality is summed up, over datasets, n of them. A dataset without queries, and one that names lacks, raise.
    """
    lacks = sorted(set(by_modality.values()) - set(metrics))
    if lacks:
        raise ValueError(f"metrics lack {lacks}")
    per = evaluate_each(queries, candidates, qrels, metrics, skip_self)
    results = staged(dataset_results(per), "results")  # a row for each dataset and metric
    empty = F.raise_error(F.concat(F.lit("no queries of dataset "), F.col("dataset"))).cast("long")
    own = names.select("dataset").join(results, "dataset", "left").select("dataset", "metric", "value", F.coalesce("n", empty).alias("n"))
    means = rollup(results, names, {m: x.replace("@", "_") for m, x in by_modality.items()})
    name = F.when(F.col("modality") == "all", "_summary").when(F.col("task") == "all", F.col("modality")).otherwise(F.concat_ws("/", "modality", "task"))
    return own.unionByName(means.select(name.alias("dataset"), F.lit("mean").alias("metric"), F.col("mean").alias("value"), "n"))
