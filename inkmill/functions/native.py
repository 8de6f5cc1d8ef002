"""The rules that need no Python: DataFrame expressions for text, tables, checksums and metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import files, markdown, pii, plain
from .text import BLANKS, EOL, WS

S = f"[{WS}]"
_BOL, _EOL = f"(?:\\A|(?<=[{EOL}]))", f"(?=[{EOL}]|\\z)"


def java(pattern: str, flags: str = "") -> str:
    """A fixed pattern as Java's expressions have it: ASCII digits and word edges, the white space of WS."""
    edge = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    out, at, inside = [], 0, False
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two == "\\b":
            out.append(edge)
        elif two == "\\s":
            out.append(WS if inside else S)
        elif two == "\\d":
            out.append("0-9" if inside else "[0-9]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or (inside and two[0] != "]")
            out.append({"^": _BOL, "$": _EOL}.get(two[0], two[0]) if not inside and "m" in flags else two[0])
            at -= 1
        at += 2
    kept = flags.replace("m", "")
    return (f"(?{kept})" if kept else "") + "".join(out)


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))  # looks at the ends alone, where an expression would try every blank of the text


def words(text: Column) -> Column:
    """TOK-09."""
    return F.when(text.isNull(), 0).otherwise(F.size(F.filter(F.split(text, f"{S}+"), lambda w: w != ""))).cast("long")


def utf16(text: Column) -> Column:
    return (F.octet_length(F.encode(F.coalesce(text, F.lit("")), "UTF-16LE")) / 2).cast("long")


def line_count(text: Column) -> Column:
    return F.size(F.split(F.coalesce(text, F.lit("")), "\n")).cast("long")


def estimate_tokens(text: Column) -> Column:
    """TOK-06 without an encoder: UTF-16 units by 3.8, rounded up, in whole numbers."""
    return F.floor((utf16(text) * 10 + 37) / 38).cast("long")


def extension(filename: Column) -> Column:
    return F.lower(F.element_at(F.split(filename, "\\."), -1))


def format_of(filename: Column, mimetype: Column) -> Column:
    """SRC-01."""
    ext = F.when(filename.contains("."), extension(filename)).otherwise(F.lit(""))
    out = F.lit("text")
    for name, extensions, parts in reversed(files.FORMATS):
        test = ext.isin(*extensions)
        for p in parts:
            test = test | (mimetype.startswith(p) if p.endswith("/") else mimetype.contains(p))
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def language(filename: Column) -> Column:
    pairs = [F.lit(x) for pair in plain.LANGUAGES.items() for x in pair]
    return F.element_at(F.create_map(*pairs), extension(filename))


def output_name(filename: Column) -> Column:
    """KB-02: the stem with .md."""
    return F.concat(stem(filename), F.lit(".md"))


def stem(filename: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(filename, "/"), -1), "(?<=.)\\.[^.]*$", "")


def doc_key(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_-]", "_")


def fenced(content: Column, lang: Column) -> Column:
    """CONV-02."""
    runs = F.transform(F.regexp_extract_all(content, F.lit("`+"), F.lit(0)), F.length)
    ticks = F.repeat(F.lit("`"), F.greatest(F.lit(2), F.coalesce(F.array_max(runs), F.lit(0))) + 1)
    return F.concat(ticks, lang, F.lit("\n"), F.regexp_replace(content, f"{S}+\\z", ""), F.lit("\n"), ticks)


def strip_boilerplate(text: Column) -> Column:
    """OPT-12 on prose: the rules one after the other."""
    for pattern, flags, to in (
        (markdown.COMMENT, "", ""), (markdown.EMPTY_TAG, "i", ""), (markdown.PAGE_MARK, "im", ""), (markdown.RULE, "m", "---"),
        (markdown.RULES, "", "---"), (markdown.GLYPH, "m", "- "), (markdown.EMPTY_BULLET, "m", ""), (markdown.TRAILING, "m", ""),
    ):
        text = F.regexp_replace(text, java(pattern, flags), to)
    return text


def tighten(text: Column, level: str) -> Column:
    """OPT-16 to 19: the end of a level, without links."""
    if level == "ultra_compact":
        text = F.regexp_replace(text, java(markdown.RULE_LINE, "m"), "")
        text = F.regexp_replace(text, java(markdown.LIST_GAP), "$1\n$2")
    text = F.regexp_replace(text, markdown.BLANK_LINES, "\n\n")
    if level == "clean":
        text = F.regexp_replace(text, java(markdown.TRAILING, "m"), "")
    return trim(text)


def compact_tables(text: Column) -> Column:
    """OPT-13."""
    row, rule = java(markdown.TABLE_ROW.strip("^$")), java(markdown.TABLE_RULE.strip("^$"))

    def cell(c: Column) -> Column:
        left, right = c.startswith(":"), c.endswith(":")
        return F.when(left & right, ":---:").when(right, "---:").when(left, ":---").otherwise("---")

    def line(x: Column) -> Column:
        cells = F.split(trim(x), "\\|")
        inner = F.transform(F.slice(cells, 2, F.size(cells) - 2), trim)
        ruled = F.when(F.regexp_like(x, F.lit(f"\\A{rule}\\z")), F.transform(inner, cell)).otherwise(inner)
        return F.when(F.regexp_like(x, F.lit(f"\\A{row}\\z")), F.concat(F.lit("|"), F.array_join(ruled, "|"), F.lit("|"))).otherwise(x)

    return F.when(text.contains("|"), F.array_join(F.transform(F.split(text, "\\r?\\n"), line), "\n")).otherwise(text)


def image_alts(text: Column, all_images: bool = False) -> Column:
    """OPT-14, OPT-15: images leave their alternative text, or nothing."""
    body = "[^)]+" if all_images else f"{S}*data:[^)]*"
    flags = "" if all_images else "(?i)"
    text = F.regexp_replace(text, f"{flags}!\\[{S}*\\]\\({body}\\)", "")
    return F.regexp_replace(text, f"{flags}!\\[{S}*([^\\]]*?){S}*\\]\\({body}\\)", "[Image: $1]")


def body_of(text: Column) -> Column:
    """OPT-22: what follows a leading YAML block."""
    rest = F.regexp_replace(text, java(markdown.FRONTMATTER.replace("\\Z", "\\z")), "")
    return F.when(rest == text, text).otherwise(F.regexp_replace(rest, f"\\A{S}*\\n", ""))


def title_of(text: Column, filename: Column) -> Column:
    """META-02 on prose."""
    head = F.regexp_extract(text, java("^#\\s+([^\\n\\r]+)$", "m"), 1)
    first = F.try_element_at(F.filter(F.split(text, "\\r?\\n"), lambda x: trim(x) != ""), F.lit(1))
    bare = F.regexp_replace(F.coalesce(first, F.lit("")), f"\\A[#*_{WS}]+|[#*_{WS}]+\\z", "")
    named = F.when(F.coalesce(filename, F.lit("")) == "", F.lit("Document")).otherwise(F.regexp_replace(filename, "\\.[^/.]+\\z", ""))
    return F.when(head != "", trim(head)).when(bare != "", bare).otherwise(named)


def description_of(text: Column) -> Column:
    """META-04 on prose."""
    kept = F.filter(
        F.transform(F.split(text, "\\r?\\n\\r?\\n"), trim),
        lambda p: (p != "") & ~p.startswith("#") & ~p.startswith("|") & ~p.startswith("```") & ~p.startswith("---"),
    )
    lead = F.coalesce(F.try_element_at(kept, F.lit(1)), F.lit(""))
    flat = F.regexp_replace(lead, "\\r?\\n", " ")
    return F.concat(F.substring(flat, 1, markdown.DESCRIPTION), F.when(F.length(lead) > markdown.DESCRIPTION, "...").otherwise(""))


def luhn(text: Column) -> Column:
    """PII-01."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def mod97(digits: Column) -> Column:
    """Remainder by 97 of a number of any length."""
    return F.aggregate(F.split(digits, ""), F.lit(0), lambda a, d: F.when(d == "", a).otherwise((a * 10 + d.cast("int")) % 97))


def iban(text: Column) -> Column:
    """PII-02."""
    bare = F.upper(F.regexp_replace(text, f"[{WS}-]", ""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))
    number = F.array_join(F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    return F.when(bare.rlike("\\A[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\\z"), mod97(number) == 1).otherwise(F.lit(False))


def nir(text: Column) -> Column:
    """PII-03."""
    bare = F.regexp_replace(text, f"[{WS}.-]", "")
    key = F.lit(97) - mod97(F.substr(bare, F.lit(1), F.lit(13)))
    return F.when(bare.rlike("\\A[12][0-9]{12}\\z"), True).when(bare.rlike("\\A[12][0-9]{14}\\z"), key == F.substr(bare, F.lit(14)).cast("int")).otherwise(False)


def masked(text: Column, entity: str, label: str) -> Column:
    """One detector without a checksum, in mask mode."""
    found = next(d for d in pii.DETECTORS if d.entity == entity)
    pattern = {"email": pii.EMAIL, "ip_address": pii.IPV4}[found.entity]
    text = F.regexp_replace(text, java(pattern), f"[{label}]")
    return text


def content_id(text: Column) -> Column:
    """CHK-01."""
    return F.concat(F.lit("doc_"), F.substring(F.sha2(text.cast("binary"), 256), 1, 12))


def savings_percentage(saved: Column, before: Column) -> Column:
    """TOK-13, KB-04: to one place, half up; none of nothing."""
    return F.when(before > 0, F.round(saved / before * 100, 1)).otherwise(0.0)


def context_strategy(total: Column, most: int = 200_000) -> Column:
    """KB-06."""
    return F.when(total <= most, F.lit("full_context")).otherwise(F.lit("rag"))
