"""Readers of corpus formats: ATF transliterations, TEI XML, lemma trees in JSON, text vectors, anchors."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.text import neutralize_entities


NUMBERED = r"^\d+[.']\s+(.*)$"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def parse_atf(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, p_number, designation, line_no, line) of Sumerian blocks.

    '&P... = name' opens a block, '#atf: lang' sets the language from there on; a line counts if it is numbered and the
    language holds where it stands, a block if the language holds at its end. A malformed header closes the block before it.
    A file is cut into blocks first and each block is read within its row, so a long dump is never one task's sorted group.
    """
    whole = F.concat(F.lit("\n"), F.regexp_replace(text, "\r\n", "\n"))
    blocks = files.select(F.col(path).alias("path"), F.posexplode(F.slice(F.split(whole, r"\n(?=[ \t]*&)"), 2, 1 << 30)).alias("block", "body"))
    lines = F.transform(F.split("body", "\n"), lambda x: F.trim(x))
    named = F.array(*[F.regexp_extract(F.get("lines", 0), r"^&(P\d+)\s*=\s*(.*)$", k) for k in (1, 2)])
    x = blocks.select("path", "block", lines.alias("lines")).withColumn("head", named).filter(F.get("head", 0) != "")

    def step(state: Column, line: Column) -> Column:
        language = line.startswith("#atf:") & line.contains("lang")
        sux = F.when(language, line.rlike(r"^#atf:\s*lang\s+sux")).otherwise(state["sux"])
        own = F.trim(F.regexp_extract(line, NUMBERED, 1))
        kept = F.when(sux & (own != ""), F.concat(state["kept"], F.array(own))).otherwise(state["kept"])
        return F.struct(sux.alias("sux"), kept.alias("kept"))

    zero = F.struct(F.lit(False).alias("sux"), F.array().cast("array<string>").alias("kept"))
    read = x.withColumn("read", F.aggregate("lines", zero, step)).filter("read.sux")
    each = read.select("path", F.get("head", 0).alias("p_number"), F.get("head", 1).alias("designation"), F.posexplode("read.kept").alias("pos", "line"))
    return each.select("path", "p_number", "designation", (F.col("pos") + 1).alias("line_no"), "line")


def parse_tei_lines(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line_id, corresp, line): the words' forms, or a line's text where it has no words; X stands for a broken word.

    Lines are cut out one by one, so one that is malformed loses no other.
    """
    body = neutralize_entities(F.col(text))
    each = files.select(F.col(path).alias("path"), F.explode(F.regexp_extract_all(body, F.lit(r"(?s)(<l\s[^>]*>.*?</l>)"), 1)).alias("x"))
    forms = F.filter(F.regexp_extract_all("x", F.lit(r"<w\s[^>]*?form=\"([^\"]*)\""), 1), lambda f: (f != "") & (f != "X"))
    plain = F.trim(F.regexp_replace(F.regexp_replace("x", "<[^>]*>", " "), r"\s+", " "))
    line = F.when(F.col("x").contains("<w "), F.array_join(forms, " ")).otherwise(plain)
    own = lambda name: F.regexp_extract(F.regexp_extract("x", r"^<l\s[^>]*>", 0), rf"\s{name}=\"([^\"]*)\"", 1)
    return each.select("path", own("id").alias("line_id"), F.nullif(own("corresp"), F.lit("")).alias("corresp"), unescape(line).alias("line")).filter("line_id <> '' AND line <> ''")


def unescape(c: Column) -> Column:
    for what, by in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(what), F.lit(by))
    return c


def parse_translations(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, key, translation): each paragraph under its corresp and its id; the last one wins."""
    each = files.select(F.col(path).alias("path"), F.posexplode(F.regexp_extract_all(neutralize_entities(F.col(text)), F.lit(r"(?s)(<p\s[^>]*>.*?</p>)"), 1)).alias("pos", "x"))
    own = lambda name: F.regexp_extract(F.regexp_extract("x", r"^<p\s[^>]*>", 0), rf"\s{name}=\"([^\"]*)\"", 1)
    body = unescape(F.trim(F.regexp_replace(F.regexp_replace("x", "<[^>]*>", " "), r"\s+", " ")))
    keyed = each.select("path", "pos", F.posexplode(F.array(own("corresp"), own("id"))).alias("o", "key"), body.alias("translation")).filter("key <> '' AND translation <> ''")
    return keyed.groupBy("path", "key").agg(F.max_by("translation", F.struct("pos", "o")).alias("translation"))


def translation_key(line_id: Column) -> Column:
    """S3: a composition's key as its translation's."""
    return F.when(line_id.startswith("c."), F.concat(F.lit("t."), F.substring(line_id, 3, 1 << 30))).otherwise(line_id)


def match_translations(lines: DataFrame, translations: DataFrame) -> DataFrame:
    """Lines (line_id, corresp, ...) with translation, by corresp and else by line_id; lines without one stay."""
    t = translations.select("key", "translation")
    first = t.withColumnsRenamed({"key": "corresp", "translation": "_t1"})
    second = t.withColumnsRenamed({"key": "line_id", "translation": "_t2"})
    return lines.join(first, "corresp", "left").join(second, "line_id", "left").withColumn("translation", F.coalesce("_t1", "_t2")).drop("_t1", "_t2")


@udtf(returnType="line_no int, pos int, form string, cf string, gw string, part string, norm string")
class LemmaTree:
    """The lemmas of a tree of nodes, in reading order; a line-start node (by type or ftype) begins a line."""

    def eval(self, raw: str, language: str) -> Iterator[tuple]:
        try:
            tree = json.loads(raw)
        except (TypeError, ValueError):
            return
        line, held, pos, stack = 0, False, 0, [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack.extend(reversed(node))
                continue
            if not isinstance(node, dict):
                continue
            if "line-start" in (node.get("type"), node.get("ftype")) and held:
                line, held = line + 1, False
            f = node.get("f")
            if isinstance(f, dict) and str(f.get("lang", "")).startswith(language) and f.get("form"):
                yield line, pos, *(str(f.get(k) or "") for k in ("form", "cf", "gw", "pos", "norm"))
                held, pos = True, pos + 1
            stack.extend(reversed(node.get("cdl") or []))


def parse_lemmas(trees: DataFrame, key: str, raw: str, language: str = "sux") -> DataFrame:
    """(key, line_no, pos, form, cf, gw, part, norm) of each tree; one that is no JSON gives none."""
    return trees.lateralJoin(LemmaTree(F.col(raw).outer(), F.lit(language))).drop(raw)


def lemma_lines(lemmas: DataFrame, key: str) -> DataFrame:
    """(key, line_no, line)."""
    forms = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "form"))), lambda s: s["form"]), " ")
    return lemmas.groupBy(key, "line_no").agg(forms.alias("line"))


def read_projects(spark: SparkSession, path: str, language: str = "sux") -> tuple[DataFrame, DataFrame]:
    """((path, p_number, lines), (path, p_number, line_no, pos, form, ...)) of project archives: every corpusjson/*.json is a text, named by its stem.

    A member that is no JSON, or has no line, gives no text.
    """
    members = read_zip_members(spark, path, r"corpusjson/[^/]*\.json$")
    trees = members.select("path", F.regexp_extract("member", r"([^/]*)\.json$", 1).alias("p_number"), "text")
    lemmas = trees.lateralJoin(LemmaTree(F.col("text").outer(), F.lit(language))).drop("text")
    form = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "form"))), lambda s: s["form"]), " ")
    lines = lemmas.groupBy("path", "p_number", "line_no").agg(form.alias("line"))
    texts = lines.groupBy("path", "p_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]).alias("lines"))
    return texts, lemmas


def vector_words(lines: DataFrame, line: str = "value") -> DataFrame:
    """(token) of 'token x1 x2 ...' lines; the numbers are never split."""
    return lines.select(F.substring_index(line, " ", 1).alias("token"))


def check_vectors(numbered: DataFrame, size: int, sample: int = 100) -> None:
    """(line_no, value) lines must have size numbers each, and the first ``sample`` words be in lower case; ValueError names the first that fails."""
    fields = F.size(F.split("value", " "))
    wrong = numbered.filter(fields != size + 1).agg(F.min(F.struct("line_no", fields.alias("n"))).alias("x")).first()["x"]
    if wrong:
        raise ValueError(f"line {wrong['line_no']}: {wrong['n'] - 1} values, not {size}")
    word = F.substring_index("value", " ", 1)
    upper = numbered.filter((F.col("line_no") <= sample) & (word != F.lower(word))).agg(F.min(F.struct("line_no", word.alias("w"))).alias("x")).first()["x"]
    if upper:
        raise ValueError(f"line {upper['line_no']}: {upper['w']!r} is not in lower case")


def parse_vectors(lines: DataFrame, line: str = "value", strict: int | None = None) -> DataFrame:
    """(token, vec) of 'token x1 x2 ...' lines; strict raises unless a line has so many numbers."""
    parts = F.split(line, " ")
    vec = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.cast("float"))
    out = lines.select(F.substring_index(line, " ", 1).alias("token"), vec.alias("vec"))
    if strict is None:
        return out
    return out.withColumn("vec", F.when(F.size("vec") == strict, F.col("vec")).otherwise(F.raise_error(F.concat(F.lit("wrong number of values for "), "token"))))


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    """An array of anchors in JSON; rows without the three fields are left out."""
    schema = "sumerian string, english string, confidence double, frequency long, source string"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.filter("sumerian IS NOT NULL AND english IS NOT NULL AND confidence IS NOT NULL")


def read_zip_members(spark: SparkSession, path: str, pattern: str = ".*") -> DataFrame:
    """(path, member, text) of the members of zip archives whose names match; undecodable bytes are replaced.

    Archives are read one at a time within a task; an unreadable one gives no rows.
    """
    import io
    import re
    import zipfile

    def work(batches):
        import pandas as pd

        wanted = re.compile(pattern)
        for pdf in batches:
            for where, content in zip(pdf["path"], pdf["content"]):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                for name in sorted(z.namelist()):
                    if wanted.search(name) and not name.endswith("/"):
                        yield pd.DataFrame({"path": [where], "member": [name], "text": [z.read(name).decode("utf-8", "replace")]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(work, "path string, member string, text string")
