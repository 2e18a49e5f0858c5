"""Readers and writers of the files a triage run uses."""

from __future__ import annotations

import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"
EVENT = "timestamp string, case_id string, state string, agent string, input_ref string, output_ref string, latency_ms long, status string, payload map<string,string>"
HINTS = "mode string, thumbnail_meta struct<slide_dimensions_level0:array<int>,thumbnail_size:array<int>>, boxes array<struct<x1:int,y1:int,x2:int,y2:int,score:double,label:string>>"
_ASSESSED = "struct<label:string,positive:boolean,score:double>"
RESULT = (
    "case_id string, label string, status string, serrated_target int, ssl_like_target int, dysplasia_proxy_target int, "
    f"hierarchical_prediction struct<serrated_lesion_assessment:{_ASSESSED},ssl_like_architecture_assessment:{_ASSESSED},dysplasia_assessment:{_ASSESSED}>, "
    "serrated_checklist map<string,struct<status:string,evidence_steps:array<string>>>, ssl_like_crypt_checklist map<string,struct<status:string,evidence_steps:array<string>>>, "
    "dysplasia_checklist map<string,struct<status:string,evidence_steps:array<string>>>, trace_clusters array<struct<cluster_id:string>>, trajectory array<struct<step_id:string>>, "
    "audit struct<warnings:array<string>,errors:array<string>,metrics:struct<trajectory_length:long,serrated_checklist_completeness:double,ssl_like_checklist_completeness:double,dysplasia_checklist_completeness:double>>, "
    "timing struct<total_runtime_ms:long>, cost struct<estimated_case_cost_units:long,trace_attempts:long,observation_steps:long>")


def read_rows(spark: SparkSession, path: str, columns: list[str], order: str | None = None) -> DataFrame:
    """A CSV with a header, every value a string. A byte-order mark is dropped.

    An empty field is "", quoted or not; a field that a short row doesn't have is null.
    ``order`` names a column with each row's place (file, start of its block, row in the block),
    which orders rows of many files as reading them one after the other would.
    """
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in columns), T.StructField("__short", T.StringType())])
    rows = spark.read.option("header", True).option("nullValue", "\u0001").option("emptyValue", "").option("columnNameOfCorruptRecord", "__short").schema(schema).csv(path)
    fields = F.coalesce(F.size(F.split("__short", r',(?=(?:[^"]*"[^"]*")*[^"]*$)')), F.lit(len(columns)))
    n = F.when(F.col("__short").isNull(), len(columns)).otherwise(fields)
    # a task numbers its rows in order, and a block of a file lies in one task
    place = [F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias(order)] if order else []
    return rows.select(*[F.when(n > i, F.coalesce(F.col(c), F.lit(""))).alias(c) for i, c in enumerate(columns)], *place)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def read_log(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """JSON lines; blank lines are skipped. Lines carry their own order, files do not."""
    return spark.read.schema(schema).json(path)


def read_run(spark: SparkSession, run_dir: str) -> DataFrame:
    """The result of each case folder that has one, with the folder's name."""
    rows = read_document(spark, f"{run_dir}/*/case_result.json", RESULT)
    return rows.withColumn("case_dir", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/case_result\.json$", 1)).orderBy("case_dir")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results as a run of this engine writes them: JSON lines, one a case."""
    return spark.read.schema(RESULT).json(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Pixels (path, y, x, r, g, b) of image files; Spark's reader keeps colours as BGR."""
    image = spark.read.format("image").load(path).select("image.origin", "image.width", "image.nChannels", "image.data")

    def pixels(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            for origin, width, channels, data in b.itertuples(index=False):
                a = np.frombuffer(data, np.uint8).reshape(-1, width, channels)
                y, x = np.mgrid[:a.shape[0], :width]
                colour = a[..., 2::-1] if channels >= 3 else np.repeat(a[..., :1], 3, axis=2)
                yield pd.DataFrame({"path": origin, "y": y.ravel(), "x": x.ravel(), **{c: colour[..., i].ravel().astype("int32") for i, c in enumerate("rgb")}})

    return image.mapInPandas(pixels, "path string, y int, x int, r int, g int, b int")


def read_hints(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, file, mode, thumb_w, thumb_h, full_w, full_h, hx1, hy1, hx2, hy2, score) of selector outputs.

    The case is the file's stem. A file without boxes gives one row with null
    boxes, as its sizes count; a size that is missing is null.
    """
    rows = read_document(spark, path, HINTS).withColumn("file", F.col("_metadata.file_name")).withColumn("case_id", stem(F.col("file")))
    meta = lambda k, i: F.try_element_at(F.col(f"thumbnail_meta.{k}"), F.lit(i + 1))
    sizes = [meta(k, i).alias(n) for k, names in (("thumbnail_size", ("thumb_w", "thumb_h")), ("slide_dimensions_level0", ("full_w", "full_h"))) for i, n in enumerate(names)]
    each = rows.select("case_id", "file", "mode", *sizes, F.explode_outer("boxes").alias("b"))
    return each.select("case_id", "file", "mode", "thumb_w", "thumb_h", "full_w", "full_h", *[F.col(f"b.{c}").alias(f"h{c}") for c in ("x1", "y1", "x2", "y2")], "b.score")


def stem(path: str | Column) -> Column:
    """A file's name without its last suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def write_documents(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", False).json(path)


PREDICTIONS = ("case_id", "label", "serrated_target", "ssl_like_target", "dysplasia_proxy_target", "serrated_pred_label", "serrated_pred_positive", "serrated_pred_score",
               "ssl_like_pred_label", "ssl_like_pred_positive", "ssl_like_pred_score", "dysplasia_pred_label", "dysplasia_pred_positive", "dysplasia_pred_score", "status")


def predictions(results: DataFrame) -> DataFrame:
    """The fifteen columns of the prediction table."""
    p = "hierarchical_prediction"
    parts = {"serrated": "serrated_lesion_assessment", "ssl_like": "ssl_like_architecture_assessment", "dysplasia": "dysplasia_assessment"}
    wide = [F.col(f"{p}.{s}.{f}").alias(f"{n}_pred_{f}") for n, s in parts.items() for f in ("label", "positive", "score")]
    return results.select("case_id", "label", "serrated_target", "ssl_like_target", "dysplasia_proxy_target", *wide, "status")


def write_predictions(results: DataFrame, path: str) -> None:
    """CSV with a header; booleans as True and False, null as nothing."""
    table = predictions(results)
    shown = [F.initcap(F.col(c).cast("string")).alias(c) if k == "boolean" else F.col(c) for c, k in table.dtypes]
    table.select(*shown).write.mode("overwrite").option("header", True).csv(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def crop_name(step: Column, m: Column, size: Column) -> Column:
    return F.format_string("%s_mag%.1f_%d.png", step, m, size)


def crop_manifest(steps: DataFrame, folder: str | Column = "") -> DataFrame:
    """Steps with the image of their crop and what is said of it."""
    where = F.lit(folder) if isinstance(folder, str) else folder
    about = F.struct("cluster_id", F.col("size").alias("region_size_level0"), "review_goal", "stage_gate", "action")
    return steps.select("case_id", "step_id", "ord", F.concat(where, crop_name(F.col("step_id"), F.col("m"), F.col("size"))).alias("image_path"), "x", "y", "m", F.col("need_to_see").alias("o"),
                        F.col("size").alias("region_size_level0"), about.alias("metadata"))


def write_crop_manifest(steps: DataFrame, path: str, folder: str | Column = "") -> None:
    """One JSON document a case: its crops in order."""
    rows = crop_manifest(steps, folder)
    one = F.struct("ord", *[c for c in rows.columns if c not in ("case_id", "ord")])
    crops_of = F.transform(F.sort_array(F.collect_list(one)), lambda x: x.dropFields("ord"))
    write_documents(rows.groupBy("case_id").agg(crops_of.alias("crops")), path)


def encode_png(width: int, height: int, rgb: bytes) -> bytes:
    """A plain PNG of 8-bit RGB rows."""
    import struct
    import zlib

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    out = io.BytesIO()
    out.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)))
    rows = b"".join(b"\x00" + rgb[y * width * 3:(y + 1) * width * 3] for y in range(height))
    out.write(chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))
    return out.getvalue()


def crops(pixels: DataFrame, *keys: str, output: int = 256) -> DataFrame:
    """(keys, png) of the pixels (keys, y, x, r, g, b) of each crop, resized to ``output``; a crop is one bounded group."""
    def draw(group):
        import numpy as np
        import pandas as pd

        y, x = group["y"] - group["y"].min(), group["x"] - group["x"].min()
        a = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 3))
        a[y, x] = group[["r", "g", "b"]]
        for axis in (0, 1):  # bilinear, one axis after the other
            n = a.shape[axis]
            if n != output:
                at = np.clip((np.arange(output) + 0.5) * n / output - 0.5, 0, n - 1)
                low = np.floor(at).astype(int)
                high, part = np.minimum(low + 1, n - 1), (at - low).reshape([-1 if i == axis else 1 for i in range(3)])
                a = np.take(a, low, axis) * (1 - part) + np.take(a, high, axis) * part
        raw = np.clip(np.round(a), 0, 255).astype(np.uint8).tobytes()
        return pd.DataFrame([[*group[list(keys)].iloc[0], encode_png(output, output, raw)]], columns=[*keys, "png"])

    kinds = dict(pixels.dtypes)
    return pixels.groupBy(*keys).applyInPandas(draw, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "png binary"]))
