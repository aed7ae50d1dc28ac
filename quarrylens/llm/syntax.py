"""Source files that do not parse: bundled grammars, LALR(1) tables, the first unrecoverable error per file."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm import lalr
from quarrylens.llm.grammars import json as _json
from quarrylens.llm.grammars import python as _python
from quarrylens.llm.grammars import toml as _toml
from quarrylens.llm.grammars import xml as _xml
from quarrylens.session import spread

GRAMMARS = {"python": _python, "json": _json, "toml": _toml, "xml": _xml}
EXTENSIONS = {"py": "python", "json": "json", "toml": "toml", "xml": "xml"}


@lru_cache(maxsize=None)
def tables(language: str) -> lalr.Tables:
    """Built once in each Python worker, in well under a second."""
    return lalr.Tables(lalr.Grammar(GRAMMARS[language].GRAMMAR))


def first_error(text: str, language: str) -> tuple[int, int, str] | None:
    """(line, column, what) of the first error, both from 1, or None where the whole text parses."""
    g = GRAMMARS[language]
    try:
        lalr.parse(tables(language), g.tokens(text), g.ACTIONS)
    except lalr.ParseError as e:
        seen = text.replace("\r\n", "\n").replace("\r", "\n")
        at = min(max(e.at, 0), len(seen))
        return seen.count("\n", 0, at) + 1, at - (seen.rfind("\n", 0, at) + 1) + 1, e.what
    return None


def language_of(path: Column) -> Column:
    """The language of the path's extension, null where no bundled grammar knows it."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    out = F.lit(None).cast("string")
    for e, lang in EXTENSIONS.items():
        out = F.when(ext == e, lang).otherwise(out)
    return out


def source_files(df: DataFrame) -> DataFrame:
    """``df`` with ``source`` and ``grammar``: what stands in the file, and the language of its extension.

    code_form ``completion`` puts the prompt (null: nothing) before generated_code, any other form and null
    takes generated_code alone. Null generated_code gives a null source.
    """
    code = F.col("generated_code")
    whole = F.when(F.col("code_form") == "completion", F.concat(F.coalesce(F.col("prompt"), F.lit("")), code)).otherwise(code)
    return df.select("record_id", "repo", "language", "file_path", whole.alias("source"), language_of(F.col("file_path")).alias("grammar"))


def check_files(files: DataFrame, key: str = "record_id", source: str = "source", grammar: str = "grammar") -> DataFrame:
    """``files`` without its source, with ``parses``, ``error_line``, ``error_column`` and ``error``.

    Every text is parsed to its end or to the first error that nothing further can repair. ``parses`` is
    null, with the reason in ``error``, where the source is null or no grammar knows the file; an empty text
    is a valid Python or TOML file and an invalid JSON or XML one. Repeated rows are judged one by one. All
    other columns of ``files`` are kept; ones that have the names of the four new ones are replaced.
    """
    new = {"parses": "boolean", "error_line": "int", "error_column": "int", "error": "string"}
    keep = [c for c in files.columns if c != source and c not in new]
    schema = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep) + ", " + ", ".join(f"{c} {t}" for c, t in new.items())
    gi = keep.index(grammar)

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                text, lang = row[-1], row[gi]
                if text is None or lang is None:
                    out.append((*row[:-1], None, None, None, "no source" if text is None else "no grammar"))
                    continue
                e = first_error(text, lang)
                out.append((*row[:-1], e is None, *(e or (None, None, None))))
            got = pd.DataFrame(out, columns=[*keep, *new], dtype=object)
            yield got

    return spread(files.select(*keep, source)).mapInPandas(run, schema)


def invalid_rates(checked: DataFrame) -> DataFrame:
    """``(repo, language, n_files, n_invalid, invalid_rate)`` over the judged files; null repo is a group.

    language is the stored one, or that of the extension where it is null.
    """
    lang = F.coalesce(F.col("language"), F.col("grammar"))
    judged = checked.filter(F.col("parses").isNotNull())
    bad = F.count_if(~F.col("parses"))
    return judged.groupBy("repo", lang.alias("language")).agg(F.count(F.lit(1)).alias("n_files"), bad.alias("n_invalid"), (bad / F.count(F.lit(1))).alias("invalid_rate"))
