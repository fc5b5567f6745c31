"""String, option-list and JSON-text expressions (all evaluated in the JVM)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalloom import constants as C
from evalloom.functions.seeded import column

# fixed values: every character that counts as white space
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column | str) -> Column:
    """Trim every kind of white space at both ends, line breaks included."""
    return F.btrim(column(c), F.lit(BLANKS))


def letter(i: Column) -> Column:
    """0 -> A, 1 -> B, ..."""
    return F.char(i + F.lit(ord("A")))


def option_keys(n: Column | str) -> Column:
    size = column(n).cast("int")
    keys = F.transform(F.sequence(F.lit(0), F.greatest(size, F.lit(1)) - 1), letter)
    return F.when(size > 0, keys).otherwise(F.array().cast("array<string>"))


def render_options(arr: Column | str, style: str = "lines") -> Column:
    before, after, joint = {"lines": ("", ": ", "\n"), "paren": ("(", ") ", "\n"), "blocks": ("- ", ": ", "\n\n")}[style]
    rows = F.transform(column(arr), lambda v, i: F.concat(F.lit(before), letter(i), F.lit(after), v.cast("string")))
    return F.array_join(rows, joint)


def expected_key(arr: Column | str, value: Column | str) -> Column:
    """Letter of ``value``; a right answer missing from its own options is an error."""
    at = F.array_position(column(arr), column(value)).cast("int")
    return F.when(at > 0, letter(at - 1)).otherwise(
        F.raise_error(F.concat(F.lit("answer is not an option: "), F.coalesce(column(value).cast("string"), F.lit("NULL"))))
    )


def render_prompt(template: str, **fields: Column | str) -> Column:
    """Fill named placeholders; plain strings in ``fields`` are column names."""
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            parts.append(column(fields[name]).cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def literal_map(pairs: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def lookup(c: Column | str, pairs: Mapping[str, str]) -> Column:
    return F.try_element_at(literal_map(pairs), column(c)) if pairs else F.lit(None).cast("string")


def describe_attributes(
    columns: Sequence[str], synonyms: Mapping[str, Mapping[str, str]], labels: Mapping[str, str]
) -> Column:
    """``synonym label, synonym label`` in the order of ``labels``; absent columns are left out."""
    return F.concat_ws(
        ", ",
        *[
            F.concat(F.coalesce(lookup(a, synonyms.get(a, {})), F.col(a)), F.lit(" " + label))
            for a, label in labels.items()
            if a in columns
        ],
    )


def wrap_instruction(c: Column | str, mode: str) -> Column:
    """``generation``, ``unconditional``, or a one-line chat for the ``text`` / ``image`` task."""
    if mode == "generation":
        return render_prompt(C.IMAGE_REQUEST, prompt=strip(c))
    if mode == "unconditional":
        return F.when(column(c).isNotNull(), C.UNCONDITIONAL_REQUEST)
    fixed = {"begin": C.CHAT_BEGIN, "system": C.CHAT_SYSTEM[mode], "answer": C.CHAT_ANSWER}
    return render_prompt(C.CHAT_LINE, question=strip(c), **{k: F.lit(v) for k, v in fixed.items()})


def clean_completion(c: Column | str, stop: str = C.CHAT_STOP, end: str = C.CHAT_END) -> Column:
    return strip(F.replace(F.substring_index(column(c), stop, 1), F.lit(end), F.lit("")))


def strip_trailing_pads(c: Column | str, pad: str) -> Column:
    """Drop repeats of ``pad`` at the right end; inner ones stay."""
    return F.regexp_replace(column(c), rf"(?:{re.escape(pad)})+\z", "")


def strip_image_tags(c: Column | str) -> Column:
    clean = F.regexp_replace(column(c), r"\s*<image \d+>\s*", " ")
    return F.when(clean.contains("<image"), F.raise_error(F.concat(F.lit("image tag left in: "), clean))).otherwise(clean)


def parse_literal_list(c: Column | str) -> Column:
    """Text of a list in Python or JSON notation -> array of strings; NULL when it is neither."""
    options = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}
    return F.from_json(column(c), "array<string>", options)


def normalize_text(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(column(c)), "[^a-z0-9 ]+", " ")


def model_of_run(c: Column | str) -> Column:
    return F.split_part(column(c), F.lit("-"), F.lit(1))


def zero_pad(c: Column | str, width: int) -> Column:
    """Left-pad with zeros; longer numbers keep all their digits."""
    text = column(c).cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def sample_id(prefix: str, split: Column | str | None, pos: Column | str, width: int) -> Column:
    parts = [F.lit(prefix), *([column(split)] if split is not None else []), zero_pad(pos, width)]
    return F.concat_ws("_", *parts)


def json_block(c: Column | str, opening: str = "{", closing: str = "}") -> Column:
    """Text from the first opening to the last closing bracket; NULL when there is none."""
    found = F.regexp_extract(column(c), rf"(?s)({re.escape(opening)}.*{re.escape(closing)})", 1)
    return F.nullif(found, F.lit(""))


STRING_OR_REST = r'"[^"\\]*+(?:\\[^\n][^"\\]*+)*+"|[^"]++|"'


def escape_newlines_in_strings(c: Column | str) -> Column:
    """Repair JSON whose quoted values contain raw line breaks."""
    tokens = F.regexp_extract_all(column(c), F.lit(STRING_OR_REST), F.lit(0))
    fixed = F.transform(
        tokens,
        lambda t: F.when(t.startswith('"') & (F.length(t) > 1), F.replace(t, F.lit("\n"), F.lit("\\n"))).otherwise(t),
    )
    return F.array_join(fixed, "")


def display_title(c: Column | str) -> Column:
    """Drop a bracketed tail and everything after the first dash."""
    return strip(F.split_part(F.regexp_replace(column(c), r"\(.*\)\z", ""), F.lit("-"), F.lit(1)))


def classify_refusal(c: Column | str) -> Column:
    """refusal / affirmative / unknown from the wording of a completion."""
    text = F.lower(strip(c))
    return (
        F.when(text == C.REFUSAL_TEXT.lower(), "refusal")
        .when(text.startswith("sure") | text.contains(C.IMAGE_MARKER), "affirmative")
        .otherwise("unknown")
    )


def id_from_file_name(c: Column | str) -> Column:
    """``face_0001.png`` -> ``0001``; ``0000`` when the name has no second part."""
    second = F.try_element_at(F.split(column(c), "_"), F.lit(2))
    return F.coalesce(F.split_part(second, F.lit("."), F.lit(1)), F.lit("0000"))


def bucket_path(idx: Column | str, extension: str = "jpg") -> Column:
    """At most 1000 files per folder: 12345 -> ``0012/12345.jpg``."""
    i = column(idx)
    return F.concat(zero_pad(F.floor(i / 1000), 4), F.lit("/"), i.cast("string"), F.lit("." + extension))


def clean_list(c: Column | str, min_len: int) -> Column:
    """Distinct, non-null strings longer than ``min_len``, sorted."""
    return F.array_sort(F.array_distinct(F.filter(column(c), lambda s: s.isNotNull() & (F.length(s) > min_len))))


def set_difference(a: Column | str, *others: Column | str) -> Column:
    rest = column(a)
    for other in others:
        rest = F.array_except(rest, column(other))
    return rest
