"""Column functions on record texts: templates, responses, fences, truncation, lists, examples."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def render_template(template: Column | str, values: Mapping[str, Column]) -> Column:
    """Replace ``{KEY}`` by each value in turn (null: empty); doubled braces stay as they are."""
    out = F.lit(template) if isinstance(template, str) else template
    for key, value in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def prompt_with_hint(question: Column, evidence: Column) -> Column:
    """The question, led by a line with the evidence where that is not blank."""
    return F.when(F.trim(F.coalesce(evidence, F.lit(""))) != "", F.concat(F.lit("Hint: "), F.trim(evidence), F.lit("\n"), question)).otherwise(question)


def truncate(text: Column, length: int, suffix: str = "...") -> Column:
    """At most ``length`` characters, with ``suffix`` where some were cut."""
    return F.when(F.char_length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit(suffix))).otherwise(text)


def parse_list(text: Column, separator: str = ",") -> Column:
    """Trimmed, non-empty parts of a separated list."""
    return F.filter(F.transform(F.split(text, re.escape(separator)), lambda x: F.trim(x)), lambda x: x != "")


def is_email(text: Column) -> Column:
    return text.rlike(r"^[\w\.-]+@[\w\.-]+\.\w+$")


def is_url(text: Column) -> Column:
    """Whether an address stands anywhere in the text."""
    return text.rlike("https?://")


def base_type(text: Column) -> Column:
    """A declared type without its arguments, in upper case."""
    return F.upper(F.trim(F.substring_index(text, "(", 1)))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.trim(text, F.lit(" \t\n\r\x0b\f"))


def last_fence(text: Column, language: str = "sql") -> Column:
    """The trimmed content of the last fenced block of a language, else the trimmed text."""
    blocks = F.regexp_extract_all(text, F.lit(rf"(?is)```{language}\s*(.*?)```"), F.lit(1))
    return F.when(F.size(blocks) > 0, strip(F.element_at(blocks, -1))).otherwise(strip(text))


def parse_reasoned_answer(text: Column) -> Column:
    """Struct of reasoning and answer from the first pair of tags; null where there is none. Of an answer with a sql fence, also among prose, the fence's inside counts."""
    pattern = r"(?s)<reasoning>(.*?)</reasoning>\s*<answer>(.*?)</answer>"
    answer = strip(F.regexp_extract(text, pattern, 2))
    fenced, bare = r"(?s)```sql(.*?)(?:```|$)", r"(?is)^```(?:sql)?\s*(.*?)\s*```$"
    answer = F.when(answer.rlike(fenced), strip(F.regexp_extract(answer, fenced, 1))).when(answer.rlike(bare), F.regexp_extract(answer, bare, 1)).otherwise(answer)
    return F.when(text.rlike(pattern), F.struct(strip(F.regexp_extract(text, pattern, 1)).alias("reasoning"), answer.alias("answer")))


def clean_json(text: Column) -> Column:
    """Without byte order marks in front and commas before closing brackets."""
    return F.regexp_replace(F.regexp_replace(text, "^[﻿​]+", ""), r",\s*([}\]])", "$1")


def _candidates(text: str) -> str:
    """What of a response looks like JSON: its first fenced block, else from its first bracket to that kind's last."""
    if fenced := re.search(r"```(?:json)?\s*(.*?)```", text, re.S | re.I):
        return fenced[1].strip()
    spans = [(a, text[a : b + 1]) for o, c in ("[]", "{}") if 0 <= (a := text.find(o)) < (b := text.rfind(c))]
    return min(spans)[1] if spans else text.strip()


def lenient_json(text: str | None) -> str | None:
    """The JSON value in a response as canonical text, or null: strict first, then with common slips mended."""
    if not text:
        return None
    found = re.sub(r",\s*([}\]])", r"\1", _candidates(text).lstrip("﻿​"))
    mended = re.sub(r"(?m)(?<![:\"'\w])//[^\n]*$|/\*.*?\*/", "", found, flags=re.S)
    mended = re.sub(r"([{,]\s*)([A-Za-z_]\w*)(\s*:)", r'\1"\2"\3', mended)
    mended = re.sub(r",\s*([}\]])", r"\1", "".join(c for c in mended if c >= " " or c in "\n\r\t"))
    for attempt in (found, mended):
        try:
            return json.dumps(json.loads(attempt), ensure_ascii=False)
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def extract_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``lenient_json`` of each text."""
    for texts in batches:
        yield texts.map(lenient_json, na_action="ignore").astype(object)


#: Types of which one example is shown.
DATE_TYPES = ("DATE", "TIME", "DATETIME", "TIMESTAMP")


def shown_examples(examples: Column, declared: Column | None = None) -> Column:
    """Up to three example values as shown in a schema: none where any is an address; of these three, one where they are long or of a date type, none where very long."""
    usable = F.filter(examples, lambda x: x.isNotNull() & (x != ""))
    first = F.slice(usable, 1, 3)
    longest = F.coalesce(F.array_max(F.transform(first, F.char_length)), F.lit(0))
    is_date = F.lit(False) if declared is None else F.coalesce(base_type(declared).isin(*DATE_TYPES), F.lit(False))
    none = F.array().cast("array<string>")
    kept = F.when(is_date, F.slice(usable, 1, 1)).when(longest > 50, none).when(longest > 20, F.slice(usable, 1, 1)).otherwise(first)
    return F.when(F.exists(usable, lambda x: is_email(x) | is_url(x)), none).otherwise(kept)


_INSERT = re.compile(r"\s*insert\s+(?:or\s+\w+\s+)?into\s+(\"[^\"]+\"|`[^`]+`|\[[^\]]+\]|\w+)\s*(\(([^)]*)\))?\s*values\s*(\(.*)", re.I | re.S)


def split_statements(text: str) -> list[str]:
    """SQL statements of a text, split at semicolons outside of quotes."""
    out, held, quote = [], [], ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        if c == ";" and not quote:
            out.append("".join(held))
            held = []
        else:
            held.append(c)
    return [s.strip() for s in [*out, "".join(held)] if s.strip()]


def split_values(text: str) -> list[str]:
    """Values of a tuple's inside, split at commas outside of quotes and brackets."""
    out, held, quote, depth = [], [], "", 0
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        if c == "," and not quote and not depth:
            out.append("".join(held).strip())
            held = []
        else:
            held.append(c)
    return [*out, "".join(held).strip()]


def parse_insert(statement: str) -> tuple[str, list[str] | None, list[list[str]]] | None:
    """(table, named columns or None, rows of value texts) of an INSERT ... VALUES statement; else None."""
    m = _INSERT.match(statement)
    if not m:
        return None
    bare = lambda x: x.strip().strip('"`[]')
    rows, depth, held, quote = [], 0, [], ""
    for c in m[4]:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "(":
            depth += 1
            if depth == 1:
                held = []
                continue
        elif c == ")":
            depth -= 1
            if depth == 0:
                rows.append(split_values("".join(held)))
        held.append(c)
    return bare(m[1]), [bare(x) for x in m[3].split(",")] if m[3] else None, rows


def parse_inserts(response: str | None) -> list[str]:
    """INSERT statements of a response's last fenced block (or of all of it)."""
    if not response:
        return []
    blocks = re.findall(r"```(?:sql)?\s*(.*?)```", response, re.S | re.I)
    return [s for s in split_statements(blocks[-1] if blocks else response) if parse_insert(s)]
