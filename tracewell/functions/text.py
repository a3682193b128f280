"""Texts of messages, prompts, diffs and JSON values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import looks_like_instructions

#: The blocks that a harness wraps around a prompt, and text limits.
WRAPPERS = "environment_context|user_instructions|environment_details|system-reminder|instructions"
WRAPPER_BLOCK = rf"(?is)<({WRAPPERS})>.*?</({WRAPPERS})>"
TURN_CHARS, OUTPUT_CHARS, MOST_TURNS, TITLE_CHARS, STATEMENT_CHARS = 16_000, 6_000, 600, 90, 1_600
#: The bytes of a turn that a judge is shown and of its verdict's texts, and what stands for the rest.
JUDGE_TURN_BYTES, VERDICT_TITLE_BYTES, VERDICT_SUMMARY_BYTES, CUT = 1_500, 90, 240, "…"
TRUNCATED = "\n… [truncated]"
#: White space as Unicode has it, which trim() alone doesn't strip.
SPACES = " \t\n\x0b\x0c\r\x85\xa0                　"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), lambda w: w != ""))


def content_text(content: Column) -> Column:
    """A message's text: a string as it is, of an array every non-empty text field, joined by line ends."""
    items = F.from_json(content, "array<struct<text:string,input_text:string,output_text:string>>")
    texts = F.flatten(F.transform(items, lambda x: F.filter(F.array(x["text"], x["input_text"], x["output_text"]), lambda t: F.coalesce(t, F.lit("")) != "")))
    return F.when(F.ltrim(content).startswith("[") & items.isNotNull(), F.array_join(texts, "\n")).otherwise(content)


def clean_prompt(text: Column) -> Column:
    return strip(F.regexp_replace(text, WRAPPER_BLOCK, " "))


def first_real_prompt(prompts: Column) -> Column:
    """Of prompts in order, the first that isn't instructions, cleaned; else the first; '' for none."""
    cleaned = F.transform(prompts, clean_prompt)
    real = F.filter(cleaned, lambda p: (p != "") & ~looks_like_instructions(p))
    return F.coalesce(F.try_element_at(real, F.lit(1)), F.try_element_at(cleaned, F.lit(1)), F.lit(""))


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(strip(F.substring(text, 1, most)), F.lit("…"))).otherwise(text)


def title(prompts: Column) -> Column:
    text = first_real_prompt(prompts)
    line = F.btrim(F.ltrim(F.substring_index(text, "\n", 1), F.lit("#> -*")))
    return F.when(text == "", "Untitled session").otherwise(shortened(line, TITLE_CHARS))


def statement(prompts: Column) -> Column:
    return shortened(first_real_prompt(prompts), STATEMENT_CHARS)


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(TRUNCATED))).otherwise(text)


def cut_bytes(text: Column, most: int, mark: str = "") -> Column:
    """A text's first most bytes in UTF-8, and mark where that is less than all.

    Of a character that the cut parts, each byte left is one U+FFFD, as JSON writers spell bytes that are no text.
    """
    data = text.cast("binary")
    head = lambda k: F.substring(data, 1, most - k).cast("string")
    cut = head(0)
    for k in range(min(most, 3), 0, -1):
        cut = F.when(F.is_valid_utf8(head(k)), F.concat(head(k), F.lit("\ufffd" * k))).otherwise(cut)
    cut = F.when(F.is_valid_utf8(head(0)), head(0)).otherwise(cut)
    return F.when(F.octet_length(text) > most, F.concat(cut, F.lit(mark))).otherwise(text)


def json_type(raw: Column) -> Column:
    """'', 'invalid', 'array', 'object', 'string', 'number', 'boolean' or 'null' of a JSON text."""
    kind = F.schema_of_variant(F.try_parse_json(raw))
    return (
        F.when(F.coalesce(F.btrim(raw), F.lit("")) == "", "").when(kind.isNull(), "invalid").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object")
        .when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")
    )


def json_keys(raw: Column) -> Column:
    """The sorted keys of a JSON object; null for other values."""
    return F.array_sort(F.json_object_keys(raw))


def command_of(value: Column) -> Column:
    """The first non-blank string among command, cmd and script of a JSON object, or of one inside a JSON string."""
    inner = F.when(F.ltrim(value).startswith('"'), F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"]).otherwise(value)
    out = F.lit("")
    for key in ("script", "cmd", "command"):
        item = F.try_variant_get(F.try_parse_json(inner), f"$.{key}", "variant")
        text = F.when(F.schema_of_variant(item) == "STRING", F.try_variant_get(F.try_parse_json(inner), f"$.{key}", "string"))
        out = F.when(strip(F.coalesce(text, F.lit(""))) != "", text).otherwise(out)
    return out


def timestamp(value: Column) -> Column:
    """An RFC 3339 time, or seconds since 1970 with or without a fraction; null for anything else."""
    epoch = F.timestamp_micros(F.round(value.try_cast("double") * 1_000_000).cast("bigint"))
    return F.coalesce(F.try_to_timestamp(F.when(value.contains("T"), value)), epoch)


def repo_path(path: Column) -> Column:
    """Slashes forward, no leading './', '.' as ''."""
    p = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"(^|/)(\./)+", "$1")
    return F.when(p == ".", "").otherwise(F.regexp_replace(F.regexp_replace(p, "/{2,}", "/"), "(?<=.)/$", ""))


def evidence_path(path: Column) -> Column:
    p = F.btrim(path, F.lit(" \t\r\n\"'"))
    return F.when((p == "") | p.contains("://"), "").when(p.startswith("/"), p).otherwise(repo_path(p))


def safe_component(name: Column) -> Column:
    """A name as one path component: other characters than letters, digits, '.', '_' and '-' become '_', '..' becomes '__'."""
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_"), r"\.\.", "__")
