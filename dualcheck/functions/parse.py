"""Response parsing expressions (R1-R3): raw model text -> field values."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import FieldSpec
from .canon import casefold, in_script, let, strip_ws

# Leading bullets/quotes and bold/backtick markers stripped from
# free-form keys; the number pattern for arbiter answers and document numbers.
LINE_CRUFT = r"(?U)^[\s\-*•>]+|[*`]"
NUMBER_PATTERN = r"[-+]?\d[\d,]*\.?\d*"
_JSON_OPTS = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}


def one_object(text: Column) -> Column:
    """Whether a text is exactly one JSON object. Inside brackets, a second
    value or anything else behind the first makes the list invalid or longer."""
    return let(objects(text), is_one)


def objects(text: Column) -> Column:
    """The JSON objects that a text lists. A text that doesn't begin with a brace is
    not read, as failing costs far more than reading."""
    found = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,string>>", _JSON_OPTS)
    return F.when(text.rlike(r"^[ \t\r\n]*\{"), found)


def is_one(found: Column) -> Column:
    """Whether ``objects``, referenced by name, are one."""
    return F.coalesce((F.size(found) == 1) & F.get(found, F.lit(0)).isNotNull(), F.lit(False))


def _struct_ddl(names: list[str]) -> str:
    return "struct<" + ",".join(f"`{n}`:string" for n in names) + ">"


def _plain_number(v: Column) -> Column:
    """1.23456785E7 -> 12345678.5, up to the size at which Python changes its form too."""
    plain = F.regexp_replace(v.try_cast("double").cast("decimal(38,18)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(v.rlike(r"^-?\d\.\d+E(?:[7-9]|1[0-5])$"), plain).otherwise(v)


def json_value(record: Column, keys: Column, name: str) -> Column:
    """Value of key ``name`` as the reference prints it: missing -> "",
    JSON null -> "None", arrays -> elements joined by "; ".

    ``record`` is the object read into a struct of strings, which keeps the last
    value of a repeated key; ``keys`` are its keys. Numbers of seven digits or
    more come back in Java's scientific form and are written out again.
    """
    v = _plain_number(record[name])
    present = F.coalesce(F.array_contains(keys, F.lit(name)), F.lit(False))
    arr = F.when(v.startswith("["), F.from_json(v, "array<string>", _JSON_OPTS))
    return (F.when(~present, F.lit(""))
            .when(v.isNull(), F.lit("None"))
            .when(arr.isNotNull(), F.array_join(arr, "; ", "None"))
            .otherwise(v))


_EXTRA_BREAKS = "[\u000b\u000c\u001c\u001d\u001e]"
_LINE = r"(?mU)^[\s\-*•>]*([^:\r\n\u0085  ]*):(.*)$"
_SEP = "\u0001"


def freeform_lines(raw: Column) -> Column:
    """R2 parse: STRUCT<keys ARRAY, values ARRAY> of the 'key: value' lines.

    Keys lose a leading run of bullets/quotes/whitespace and every '*' or '`',
    are stripped and case-folded; values are everything after the first ':'.
    Two scans of the text and a few passes over the joined keys, no per-line
    function. Jobs take its steps one by one, each from a column referenced by name.
    """
    text = freeform_text(raw)
    return freeform_pairs(F.regexp_extract_all(text, F.lit(_LINE), 1), F.regexp_extract_all(text, F.lit(_LINE), 2))


def freeform_text(raw: Column) -> Column:
    return F.regexp_replace(F.coalesce(raw, F.lit("")), _EXTRA_BREAKS, "\n")


def freeform_part(text: Column, group: int) -> Column:
    """The raw keys (1) or the values (2) of all lines."""
    return in_script(text, _LINE, lambda c, p: F.regexp_extract_all(c, F.lit(p), group))


def freeform_pairs(keys: Column, vals: Column) -> Column:
    joined = F.regexp_replace(F.array_join(keys, _SEP), r"[*`]", "")
    joined = F.regexp_replace(joined, rf"(?U)\s*{_SEP}\s*", _SEP)
    cleaned = F.split(casefold(strip_ws(joined)), _SEP)
    return F.struct(F.when(F.size(keys) > 0, cleaned).otherwise(keys).alias("keys"),
                    vals.alias("values"))


def freeform_lookup(lines: Column, name: str) -> Column:
    """Value of the last line keyed ``name`` (may overwrite with ''), else ''."""
    keys, vals = lines["keys"], lines["values"]
    back = F.array_position(F.reverse(keys), F.lit(name.casefold()))
    idx = F.size(keys) - back + 1
    return F.when(back > 0, strip_ws(F.element_at(vals, idx.cast("int")))).otherwise(F.lit(""))


def clean_answer(spec: FieldSpec, raw: Column) -> Column:
    """Strip padding from an arbiter answer, type-aware."""
    t = F.regexp_replace(strip_ws(F.coalesce(raw, F.lit(""))), r"^[\"'. ]+|[\"'. ]+$", "")
    if spec.type == "enum" and spec.enum:
        low = casefold(t)
        picks = [F.when(F.instr(low, F.lit(v.casefold())) > 0, F.lit(v)) for v in spec.enum]
        return F.coalesce(*picks, t)
    if spec.numeric:
        if spec.multi:
            nums = F.regexp_extract_all(t, F.lit(NUMBER_PATTERN), 0)
            return F.when(F.size(nums) > 0, F.array_join(nums, "; ")).otherwise(t)
        first = F.regexp_extract(t, NUMBER_PATTERN, 0)
        return F.when(first != "", first).otherwise(t)
    return t
