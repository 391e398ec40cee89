"""Export of conversations as Markdown or plain text, with manifests."""

from __future__ import annotations

import csv
import io
import json
import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talktree.functions.text import is_internal
from talktree.functions.values import export_name, finite, name_key, time_text
from talktree.operators.archive import Archive
from talktree.operators.search import reading_keys
from talktree.plans.predicates import conversation_time, in_dates
from talktree.plans.query import Query
from talktree.sources.sink import write_rows

FORMATS = ("md", "txt")
#: Columns of a manifest, in order.
MANIFEST = [
    "aggregate_hash", "conversation_id", "create_time", "current_node", "format", "include_internal",
    "output_hash", "output_path", "path", "source_file", "title", "update_time",
]
_NODE = ["conversation_id", "node_id"]


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _field(template: str, value: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), F.coalesce(value, F.lit("")), F.lit(after))


def header(fmt: str) -> Column:
    """What stands before the messages; it depends on the archive only, so exports are stable."""
    c = F.col
    title = F.when(F.coalesce("title", F.lit("")) == "", "untitled").otherwise(c("title"))
    fields = [("conversation_id", c("conversation_id"), True), ("create_time", time_text(c("create_time")), False), ("update_time", time_text(c("update_time")), False), ("current_node", c("current_node"), True), ("source_file", c("source_file"), True)]
    if fmt == "md":
        rows = [_field(f"- {n}: `{{}}`" if code else f"- {n}: {{}}", v) for n, v, code in fields]
        return _lines(F.concat(F.lit("# "), title), "", *rows, "", "")
    return _lines(title, *(_field(f"{n}: {{}}", v) for n, v, _ in fields), "=" * 72, "")


def message(fmt: str) -> Column:
    """One rendered message of columns role, create_time, update_time and text."""
    role = F.when(F.coalesce("role", F.lit("")) == "", "message").otherwise(F.col("role"))
    time = time_text(F.coalesce("create_time", "update_time"))
    if fmt == "md":
        return _lines(F.concat(F.lit("## "), F.initcap(role), F.when(time != "", F.concat(F.lit(" "), time)).otherwise("")), "", F.col("text"), "")
    return _lines(F.trim(F.concat(F.upper(role), F.lit(" "), time)), "-" * 72, F.col("text"), "")


def exported_messages(archive: Archive, path: str = "current", include_internal: bool = False) -> DataFrame:
    """Messages that an export holds, with ``_order`` in their conversation."""
    rows = archive.texts.where(F.col("text") != "")
    if not include_internal:
        rows = rows.where(~is_internal(F.col("role"), F.col("content_type"), F.col("text")))
    if path == "current":
        return rows.join(archive.paths.select(*_NODE, F.col("position").alias("_order")), _NODE)
    return rows.withColumn("_order", F.row_number().over(Window.partitionBy("conversation_id").orderBy(*reading_keys())).cast("long"))


def _joined(parts: Column, between: str) -> Column:
    return F.array_join(F.transform(F.array_sort(parts), lambda x: x["text"]), between)


def selected(archive: Archive, date_from: float | None = None, date_to: float | None = None) -> DataFrame:
    """Conversations of a date range, in export order."""
    q = Query(after=date_from, before=date_to)
    return archive.conversations.where(in_dates(q, conversation_time())).orderBy(F.coalesce("create_time", "update_time", F.lit(0.0)), "conversation_id")


def rendered(archive: Archive, formats: tuple[str, ...] = FORMATS, path: str = "current", include_internal: bool = False, date_from: float | None = None, date_to: float | None = None) -> DataFrame:
    """``(conversation_id, format, content)``: every conversation in every format."""
    rows = exported_messages(archive, path, include_internal)
    conv = selected(archive, date_from, date_to)
    out = None
    for fmt in formats:
        parts = rows.groupBy("conversation_id").agg(F.collect_list(F.struct("_order", "node_id", message(fmt).alias("text"))).alias("_parts"))
        whole = F.concat(header(fmt), F.coalesce(_joined(F.col("_parts"), ""), F.lit("")))
        one = conv.join(parts, "conversation_id", "left").select("conversation_id", F.lit(fmt).alias("format"), F.concat(F.regexp_replace(whole, r"(?U)\s+\z", ""), F.lit("\n")).alias("content"))
        out = one if out is None else out.union(one)
    return out


def copy_stream(archive: Archive, path: str = "current", include_internal: bool = True) -> DataFrame:
    """``(conversation_id, content)``: ``role:`` and text of each message, a blank line between them."""
    rows = exported_messages(archive, path, include_internal).where(F.trim("text") != "")
    one = F.concat(F.coalesce("role", F.lit("message")), F.lit(":\n"), F.col("text"))
    parts = rows.groupBy("conversation_id").agg(F.collect_list(F.struct("_order", "node_id", one.alias("text"))).alias("_parts"))
    return parts.select("conversation_id", _joined(F.col("_parts"), "\n\n").alias("content"))


def _name(number: Column | None = None) -> Column:
    return export_name(F.col("title"), F.col("conversation_id"), F.coalesce("create_time", "update_time"), F.col("format"), number)


def file_names(conversations: DataFrame, formats: tuple[str, ...] = FORMATS) -> DataFrame:
    """``(conversation_id, format, output_path)``: file names, no two equal on any system.

    A name that is one of a kind stays.  Equal ones are numbered by format and id with the next numbers
    whose names are nobody's natural name, and are not given to an earlier group of equal names.
    """
    rows = conversations.select("conversation_id", "title", "create_time", "update_time", F.explode(F.array(*map(F.lit, formats))).alias("format"))
    rows = rows.withColumn("_natural", _name()).withColumn("_key", name_key(F.col("_natural")))
    again = rows.groupBy("_key").agg(F.count("*").alias("_same")).where("_same > 1")
    if not again.limit(1).count():  # as a rule, for ids are part of names; then nothing has to be dealt by name
        return rows.select("conversation_id", "format", F.col("_natural").alias("output_path"))
    same = Window.partitionBy("_key")
    rows = rows.withColumns({"_same": F.count("*").over(same), "_rank": F.row_number().over(same.orderBy("format", "conversation_id"))})
    single = rows.where("_same = 1").select("conversation_id", "format", F.col("_natural").alias("output_path"))
    twice = rows.where("_same > 1")
    spare = 8
    while True:
        numbers = twice.where("_rank = 1").withColumn("_number", F.explode(F.sequence(F.lit(1), (F.col("_same") + spare).cast("int"))))
        tried = numbers.withColumn("_name", _name(F.col("_number"))).select("_key", "_number", name_key(F.col("_name")).alias("_tried"))
        free = tried.join(rows.select(F.col("_key").alias("_tried")).distinct(), "_tried", "left_anti")
        first = F.row_number().over(Window.partitionBy("_tried").orderBy("_key", "_number"))
        free = free.withColumn("_first", first).where("_first = 1")
        free = free.withColumn("_rank", F.row_number().over(Window.partitionBy("_key").orderBy("_number"))).select("_key", "_rank", "_number")
        given = twice.join(free, ["_key", "_rank"], "left")
        if not given.where("_number is null").limit(1).count():
            break
        spare *= 16  # so many numbers are taken by other names
    return single.union(given.select("conversation_id", "format", _name(F.col("_number")).alias("output_path")))


def manifest(archive: Archive, content: DataFrame, path: str = "current", include_internal: bool = False) -> DataFrame:
    """A row for each rendered file, sorted by name."""
    formats = tuple(FORMATS)
    names = file_names(archive.conversations, formats)
    rows = content.select("conversation_id", "format", F.sha2("content", 256).alias("output_hash")).join(names, ["conversation_id", "format"]).join(archive.conversations, "conversation_id")
    rows = rows.withColumns({"create_time": finite(F.col("create_time")), "update_time": finite(F.col("update_time")), "path": F.lit(path), "include_internal": F.lit(include_internal)})
    return rows.select(*MANIFEST).orderBy("output_path", "conversation_id", "format")


def manifest_jsonl(rows: DataFrame) -> DataFrame:
    """A ``value`` column of JSON lines with sorted keys; nulls are written."""
    return rows.select(F.to_json(F.struct(*MANIFEST), {"ignoreNullFields": "false"}).alias("value"))


def write_export(archive: Archive, folder: str, **options) -> DataFrame:
    """Writes content and manifests below ``folder`` and returns the manifest.

    Content goes to ``files`` with a partition for each format and a row for each file; manifests to
    ``manifest_jsonl`` and ``manifest_csv``, whose parts are sorted ranges of names.
    """
    content = rendered(archive, **options)
    kept = {k: v for k, v in options.items() if k in ("path", "include_internal")}
    rows = manifest(archive, content, **kept)
    named = content.join(file_names(archive.conversations), ["conversation_id", "format"])
    named.write.mode("overwrite").partitionBy("format").parquet(f"{folder}/files")
    manifest_jsonl(rows).write.mode("overwrite").text(f"{folder}/manifest_jsonl")
    rows.write.mode("overwrite").option("header", "true").option("nullValue", "").csv(f"{folder}/manifest_csv")
    return rows


def write_files(named: DataFrame, folder: str) -> dict[str, int]:
    """Writes (output_path, content) rows as files of a folder, those only whose content changed.

    Executors write them; a file is written aside and then moved to its place, so it is never seen in
    part.  Returns how many were written and left alone.
    """
    return write_rows(named.select(F.element_at(F.split("output_path", r"[/\\\\]"), -1).alias("path"), "content"), folder)


def write_manifests(rows: DataFrame, folder: str) -> None:
    """Writes sorted manifest rows as ``manifest.jsonl`` and ``manifest.csv`` of a local folder, both or neither.

    Rows come to the driver one partition at a time.  If either file can't be moved to its place, the
    former pair is put back.
    """
    os.makedirs(folder, exist_ok=True)
    place = {n: os.path.join(folder, n) for n in ("manifest.jsonl", "manifest.csv")}
    part, former = ({n: os.path.join(folder, f".{kind}-{n}") for n in place} for kind in ("part", "former"))
    with open(part["manifest.jsonl"], "w", encoding="utf-8") as lines, open(part["manifest.csv"], "w", encoding="utf-8", newline="") as table:
        table.write(csv_line(dict(zip(MANIFEST, MANIFEST))))
        for row in rows.toLocalIterator():
            lines.write(json.dumps(row.asDict(), ensure_ascii=False, sort_keys=True) + "\n")
            table.write(csv_line(row.asDict()))
    kept = [n for n in place if os.path.isfile(place[n])]
    try:
        for n in kept:
            os.replace(place[n], former[n])
        for n in place:
            os.replace(part[n], place[n])
    except OSError:
        for n in place:
            if n in kept and os.path.isfile(former[n]):
                os.replace(former[n], place[n])
            elif n not in kept and os.path.isfile(place[n]):
                os.remove(place[n])
        raise
    for n in kept:
        os.remove(former[n])


def changed(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Manifest rows whose content is not what was last exported under that name."""
    last = latest_exports(log).select("conversation_id", "format", "output_path", F.col("output_hash").alias("_last"))
    return rows.join(last, ["conversation_id", "format", "output_path"], "left").where(~F.col("output_hash").eqNullSafe(F.col("_last"))).drop("_last")


def export_log(rows: DataFrame, exported_at: str, options: dict) -> DataFrame:
    """Rows of the ``exports`` table for a manifest."""
    return rows.select("conversation_id", "format", "output_path", "output_hash", F.lit(exported_at).alias("exported_at"), F.lit(json.dumps(options, sort_keys=True)).alias("export_options_json"))


def latest_exports(log: DataFrame) -> DataFrame:
    """The last row of each conversation, format and name."""
    order = Window.partitionBy("conversation_id", "format", "output_path").orderBy(F.desc("exported_at"), F.desc("output_hash"))
    return log.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def csv_line(row: dict) -> str:
    """One manifest row as CSV text."""
    out = io.StringIO(newline="")
    csv.DictWriter(out, MANIFEST, lineterminator="\n").writerow(row)
    return out.getvalue()
