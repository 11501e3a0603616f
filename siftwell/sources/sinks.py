"""Result sinks: JSON, CSV, XML, Markdown, file lists and terminal lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.errors import InvalidInput
from siftwell.functions import text as X


def markdown_row(title: Column, path: Column) -> Column:
    return F.concat(F.lit("## "), title, F.lit("\n\n**Path:** `"), path, F.lit("`"))


def xml_element(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), X.xml_text(value), F.lit(f"</{name}>"))


def _percent(score: Column) -> Column:
    return F.concat(F.round(score * 100).cast("int").cast("string"), F.lit("%"))


def lines(results: DataFrame, form: str) -> DataFrame:
    """``ord, line`` of a result page (path, title, score, docid, ord and more) in a form.

    Forms: json, csv, xml, md, files, cli. Scores in JSON are rounded to two places.
    """
    score = F.round("score", 2)
    made = {
        "json": F.to_json(F.struct(*[score.alias("score") if c == "score" else F.col(c) for c in results.columns if c != "ord"])),
        "csv": F.concat_ws(",", *[X.csv_field(c) for c in (score.cast("string"), F.col("path"), F.coalesce("title", F.lit("")), F.col("docid"))]),
        "xml": F.concat(F.lit("<result>"), *[xml_element(n, c) for n, c in (("docid", F.col("docid")), ("score", score.cast("string")), ("path", F.col("path")), ("title", F.coalesce("title", F.lit(""))))], F.lit("</result>")),
        "md": F.concat(markdown_row(F.coalesce("title", F.col("path")), F.col("path")), F.lit("\n**Score:** "), _percent(F.col("score")), F.lit("\n")),
        "files": F.concat_ws(",", F.concat(F.lit("#"), "docid"), score.cast("string"), "path"),
        "cli": F.concat(_percent(F.col("score")), F.lit(" "), "path", F.lit(" #"), "docid", F.lit("\n  "), F.coalesce("title", F.lit(""))),
    }
    if form not in made:
        raise InvalidInput(f"no form {form!r}; there are {sorted(made)}")
    return results.select("ord", made[form].alias("line"))


def write(results: DataFrame, path: str, form: str) -> None:
    """Write a page as text in its order; json, csv and parquet by Spark's own writers."""
    flat = results.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) and form == "csv" else F.col(c) for c, t in results.dtypes])
    if form in ("parquet", "json"):
        getattr(results.write.mode("overwrite"), form)(path)
    elif form == "csv":
        flat.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
    elif form == "xml":
        results.write.mode("overwrite").option("rowTag", "result").format("xml").save(path)
    else:
        lines(results, form).sort("ord").select("line").write.mode("overwrite").text(path)
