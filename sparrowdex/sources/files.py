"""Landed files as tables: markdown trees, page payloads, wikitext dumps, eval cases and reports."""

from __future__ import annotations

import json
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E

SUFFIXES = ("md", "markdown", "mdx")


#: Bytes of files with hidden names that the driver reads itself at most.
HIDDEN_BYTES = 64 << 20


def _hidden(spark: SparkSession, root: str) -> tuple[list[str], list[tuple[str, str, int]]]:
    """What Spark's listing would pass over below ``root``, outside folders that begin with a dot.

    Folders whose name begins with an underscore, and (path, text, milliseconds of change) of markdown files whose name begins with an
    underscore or a dot; an error where these files have more than ``HIDDEN_BYTES``.
    """
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    folders, texts, size, open_ = [], [], 0, [top]
    while open_:
        for status in fs.listStatus(open_.pop()):
            path = status.getPath()
            name = path.getName()
            if status.isDirectory() and not name.startswith("."):
                open_.append(path)
                if name.startswith("_"):
                    folders.append(path.toString())
            elif status.isFile() and name[0] in "._" and name.lower().endswith(tuple(f".{x}" for x in SUFFIXES)):
                size += status.getLen()
                if size > HIDDEN_BYTES:
                    raise ValueError(f"files with hidden names below {root} have more than {HIDDEN_BYTES} bytes")
                stream = fs.open(path)
                texts.append((path.toUri().getPath(), bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8"), status.getModificationTime()))
                stream.close()
    return folders, texts


def markdown_tree(spark: SparkSession, root: str) -> DataFrame:
    """(source_path, raw, modified) of the markdown files below ``root``, by their path within it; nothing in folders whose name begins with a dot.

    The driver lists folders, executors read the files; only files whose own name begins with a dot or an underscore, which
    Spark's readers take for hidden, are read by the driver, up to ``HIDDEN_BYTES`` of them.  Bytes that aren't UTF-8 are an error.
    """
    folders, texts = _hidden(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([root, *folders])
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rows = files.select(F.regexp_replace(path, r"^[a-z0-9]+:/+", "/").alias("path"), F.col("content"), F.col("modificationTime").alias("modified"))
    few = spark.createDataFrame(texts, "path string, raw string, at long").select("path", F.col("raw").cast("binary").alias("content"), F.timestamp_millis("at").alias("modified"))
    base = root.split("://", 1)[-1].rstrip("/") + "/"
    rows = rows.unionByName(few).withColumn("source_path", F.substring_index("path", base, -1))
    kept = F.lower(F.col("source_path")).rlike(r"\.(" + "|".join(SUFFIXES) + ")$") & ~F.col("source_path").rlike(r"(^|/)\.[^/]*/")
    return rows.where(kept).select("source_path", F.decode("content", "UTF-8").alias("raw"), "modified")


def window_json(html: Column, name: str) -> Column:
    """The JSON text assigned to window.NAME in a page; an error where there is none."""
    found = F.regexp_extract(html, rf"(?s)window\.{name}\s*=\s*(\{{.*?\}});", 1)
    return F.when(found == "", F.raise_error(F.lit(f"no window.{name} in the page")).cast("string")).otherwise(found)


def meta_content(html: Column, name: str) -> Column:
    """The content of a named meta tag; an error where there is none."""
    found = F.regexp_extract(html, rf'(?i)<meta\s+name="{name}"\s+content="([^"]+)"', 1)
    return F.when(found == "", F.raise_error(F.lit(f"no meta tag {name} in the page")).cast("string")).otherwise(found)


_PAGE = "struct<id:bigint,uid:string,name:string,visibility:string,category_overview_page:boolean>"


def page_index(details: DataFrame) -> DataFrame:
    """(page_id, uid, page_name, category_name, navigation_id, page_visibility) from navigation trees (``json``: categories with pages); of a repeated page the last place counts."""
    tree = F.from_json("json", f"struct<categories:array<struct<name:string,navigation_id:string,pages:array<{_PAGE}>>>>")
    rows = details.select(F.posexplode(tree["categories"]).alias("at", "c")).select("at", F.col("c.name").alias("category_name"), F.col("c.navigation_id").alias("navigation_id"), F.posexplode("c.pages").alias("place", "p"))
    last = rows.groupBy("p.id").agg(F.max(F.struct("at", "place", "category_name", "navigation_id", "p")).alias("x"))
    return last.select(F.col("id").alias("page_id"), "x.p.uid", F.col("x.p.name").alias("page_name"), "x.category_name", "x.navigation_id", F.col("x.p.visibility").alias("page_visibility"))


def landed_pages(payloads: DataFrame) -> DataFrame:
    """(id, name, page_visibility, introduction_node, content_node) of payloads (``json``: an object with a list of pages); an error where there is no list."""
    listed = F.get_json_object("json", "$.pages")
    checked = F.when(listed.isNull() | ~F.coalesce(listed, F.lit("")).startswith("["), F.raise_error(F.lit("the payload has no list of pages")).cast("string")).otherwise(listed)
    page = F.explode(F.from_json(checked, "array<struct<id:bigint,name:string,page_visibility:string,introduction_node:string,content_node:string>>"))
    return payloads.select(page.alias("p")).select("p.*")


def included_pages(pages: DataFrame, index: DataFrame) -> DataFrame:
    """Landed pages with their place in the index, without unnamed, reserved, hidden and empty ones."""
    rows = pages.join(index, pages["id"] == index["page_id"], "left")
    seen = F.coalesce(F.nullif(pages["page_visibility"], F.lit("")), index["page_visibility"], F.lit(""))
    name = F.coalesce("name", F.lit(""))
    kept = (name != "") & ~name.startswith("___") & (seen != "hidden") & (F.coalesce("introduction_node", "content_node").isNotNull())
    return rows.where(kept).select("id", "name", "uid", F.col("category_name").alias("category"), "introduction_node", "content_node")


def wiki_dump(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(title, wikitext, scraped) of a landed dump of JSON lines, the first ``limit`` by title if given."""
    rows = spark.read.schema("title string, wikitext string, scraped timestamp").json(path).where("title is not null and wikitext is not null")
    return rows.orderBy("title").limit(limit) if limit else rows


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Eval cases of a YAML or JSON file: a list, or an object with the list as ``cases``; an error for anything else."""
    raw = spark.read.text(path, wholetext=True).head()[0]
    if path.lower().endswith((".yml", ".yaml")):
        import yaml

        data = yaml.safe_load(raw)
    else:
        data = json.loads(raw)
    cases = data.get("cases") if isinstance(data, dict) else data
    if not isinstance(cases, list) or not all(isinstance(c, dict) for c in cases):
        raise ValueError("an eval file is a list of cases or an object with that list as cases")
    schema = spark.createDataFrame([], E.CASE).schema
    return E.with_defaults(spark.createDataFrame([tuple(c.get(f) for f in schema.names) for c in cases], schema))


def report_artifact(spark: SparkSession, path: str) -> DataFrame:
    """Outcomes of a stored run (JSON): an object with outcomes, or one nested below ``eval``."""
    rows = spark.read.json(path, multiLine=True)
    at = F.col("eval.outcomes") if "eval" in rows.columns else F.col("outcomes")
    return rows.select(F.explode(at).alias("o")).select("o.*")


def worktree(path: str) -> dict:
    """State of a local checkout: is_git_repo, clean, status_lines and commit (null outside a repository)."""
    run = lambda *args: subprocess.run(["git", "-C", path, *args], capture_output=True, text=True)
    status = run("status", "--porcelain")
    if status.returncode:
        return {"is_git_repo": False, "clean": None, "status_lines": [], "commit": None}
    head = run("rev-parse", "HEAD")
    lines = status.stdout.splitlines()
    return {"is_git_repo": True, "clean": not lines, "status_lines": lines, "commit": None if head.returncode else head.stdout.strip()}
