"""Result writers: documents as Markdown or JSON, event lines, figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import schemas


def _event(kind: str, /, **fields: Column) -> Column:
    return F.struct(F.lit(schemas.SCHEMA_VERSION).alias("schema_version"), F.lit(kind).alias("event"), *[v.alias(k) for k, v in fields.items()])


def run_start(command: Column) -> Column:
    return _event("run_start", command=command)


def run_complete(command: Column, markdown: Column) -> Column:
    return _event("run_complete", command=command, markdown=markdown)


def run_error(command: Column, kind: Column, code: Column, message: Column) -> Column:
    return _event("run_error", command=command, error_kind=kind, code=code, message=message)


def page_decoded(page: Column, text: Column) -> Column:
    """chars counts code points."""
    return _event("page", page=page, status=F.lit("decoded"), chars=F.length(text).cast("long"), text=text)


def page_skipped(page: Column, reason: Column) -> Column:
    return _event("page", page=page, status=F.lit("skipped"), reason=reason)


def staff(index: Column, total: Column, ok: Column, bbox: Column) -> Column:
    return _event("staff", staff=index + 1, total=total, status=F.when(ok, "ok").otherwise("skipped"), bbox=bbox)


def music_warning(kind: Column, part: Column, measure: Column, detail: Column) -> Column:
    return _event("music_warning", kind=kind, part=part, measure=measure, detail=detail)


def lines(rows: DataFrame, event: Column) -> DataFrame:
    """One JSON object per line; absent where a field is null."""
    return rows.select(F.to_json(event).alias("value"))


def write_lines(rows: DataFrame, event: Column, path: str) -> None:
    lines(rows, event).write.text(path)


def write_documents(docs: DataFrame, path: str, as_json: bool = False) -> None:
    """doc_id and markdown: JSON by request or by the path's extension in any case, else Markdown with a line feed at the end."""
    if as_json or path.lower().rstrip("/").endswith(".json"):
        docs.select(F.to_json(F.struct("doc_id", "markdown")).alias("value")).write.text(path)
        return
    body = F.regexp_replace("markdown", "\n\\z", "")  # the writer ends each file with one
    docs.select("doc_id", body.alias("value")).write.partitionBy("doc_id").text(path)


def figure_name(page: Column, n: Column) -> Column:
    return F.concat(F.lit("page"), page.cast("string"), F.lit("_figure_"), n.cast("string"))


def link_figures(markdown: Column, figures: Column) -> Column:
    """Rewrites each figure's token to a link; figures is an array of struct(token, name, format)."""

    def step(text: Column, f: Column) -> Column:
        return F.replace(text, f["token"], F.concat(F.lit("![]("), f["name"], F.lit("."), f["format"], F.lit(")")))

    return F.aggregate(figures, markdown, step)
