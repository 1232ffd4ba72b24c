"""Tokens, query references, citations and other text expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token pattern, word list and reference patterns decide which terms match.
TOKEN = r"[A-Za-z0-9][A-Za-z0-9._\-/]*[A-Za-z0-9]|[A-Za-z0-9]"
CAMEL = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
SEPARATOR = r"[-_/]"
STOPWORDS = (
    "the", "a", "an", "of", "to", "in", "for", "and", "or", "is", "are", "be", "been", "as", "at", "by", "on",
    "it", "its", "this", "that", "with", "from", "which", "if", "then", "else", "was", "were",
)
# (?iU) stands for a pattern compiled without regard to case over Unicode classes.
SPEC_REFERENCE = r"(?iU)\b(?:TS\s*|TR\s*)?(\d{2}\.\d{3})\b"
CLAUSE_REFERENCE = r"(?iU)(?:clause|section|§)\s*([0-9]+(?:\.[0-9A-Za-z]+)*)"
NORMATIVE = r"(?i)\b(shall|shall not|must|should|should not|may|need not)\b"

#: White space of any script, no-break spaces included.
BLANK = r"(?U)[\s\x1C-\x1F]+"


def bound(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def one_line(text: Column) -> Column:
    """White space of a heading as single spaces."""
    return F.trim(F.regexp_replace(text, BLANK, " "))


def n_words(text: Column) -> Column:
    """The default token counter: runs of other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("int")


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def is_stopword(term: Column) -> Column:
    return term.isin(*STOPWORDS)


def token_forms(raw: Column) -> Column:
    """The forms of one token: itself, parts between separators, pieces of mixed case."""
    low = F.lower(raw)

    def extras(parts: Column) -> Column:
        sources = F.when(F.size(parts) > 0, parts).otherwise(F.array(raw))
        humps = F.transform(sources, lambda p: F.filter(F.split(p, CAMEL), lambda x: F.length(x) >= 3))
        humps = F.flatten(F.filter(humps, lambda h: F.size(h) > 1))
        return F.concat(F.when(F.size(parts) > 1, parts).otherwise(F.slice(parts, 1, 0)), humps)

    more = bound(F.filter(F.split(raw, SEPARATOR), lambda p: F.length(p) >= 2), extras)
    more = F.filter(F.transform(more, lambda x: F.lower(x)), lambda x: (x != low) & ~is_stopword(x))
    # Most tokens have one form; only the others pay for the splits.
    several = raw.rlike(r"[-_/]|[a-z0-9][A-Z]|[A-Z][A-Z][a-z]")
    first = F.when(is_stopword(low), F.slice(F.array(low), 1, 0)).otherwise(F.array(low))
    return F.when(several, F.concat(first, more)).otherwise(first)


def tokenize(text: Column) -> Column:
    """All searchable forms of a text in order, repeats kept."""
    return F.flatten(F.transform(raw_tokens(text), token_forms))


def references(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def query_plan(question: Column) -> Column:
    """Documents and clauses that a question names."""
    clauses = references(question, CLAUSE_REFERENCE)
    return F.struct(
        references(question, SPEC_REFERENCE).alias("specs"), clauses.alias("clauses"), (F.size(clauses) > 0).alias("is_pinpoint")
    )


def has_normative(text: Column) -> Column:
    return text.rlike(NORMATIVE)


def citation(spec_id: Column, version: Column, clause_id: Column) -> Column:
    return F.format_string("%s v%s, clause %s", spec_id, version, clause_id)


def context_header(spec_id, version, release, title, breadcrumb, clause_id, clause_title, part, n_parts) -> Column:
    """What stands above a chunk in the text to index."""
    name = F.when(clause_id == clause_title, clause_id).otherwise(F.concat_ws(": ", clause_id, clause_title))
    tail = F.when(n_parts > 1, F.format_string(" [part %d/%d]", part, n_parts)).otherwise("")
    head = F.format_string("%s v%s (Rel-%d)", spec_id, version, release)
    filled = lambda c, made: F.when(F.coalesce(c, F.lit("")) != "", made)
    head = F.concat(head, F.coalesce(filled(title, F.concat(F.lit(" - "), title)), F.lit("")))
    return F.concat_ws("\n", head, filled(breadcrumb, breadcrumb), F.concat(F.lit("Clause "), name, tail))


def judge_number(reply: Column) -> Column:
    """First word of a judge's reply as a number in [0, 1]; 0 if it isn't one, NaN included."""
    x = F.split(strip(reply), BLANK)[0].try_cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def error_status(message: Column) -> Column:
    """Three-digit status at the start of an error message, else null."""
    digits = F.regexp_replace(F.substring(message, 1, 4), "[^0-9]", "")
    return F.when(F.length(digits) >= 3, digits.try_cast("int"))


def prompt(question: Column, hits: Column) -> Column:
    """The question and numbered passages, in the fixed layout. hits: array of struct(citation, breadcrumb, clause_title, text)."""
    none = lambda c: F.coalesce(c, F.lit(""))
    one = lambda h, i: F.format_string(
        "\n[%d] %s\n    section: %s\n    title:   %s\n%s", i + 1, h["citation"], none(h["breadcrumb"]), none(h["clause_title"]), h["text"]
    )
    head = F.concat(F.lit("QUESTION: "), question, F.lit("\n\nPASSAGES:"))
    return F.array_join(F.concat(F.array(head), F.transform(hits, one)), "\n")


def markdown_table(rows: Column) -> Column:
    """array<array<string>> as a pipe table; rows of empty cells go, short rows are filled up."""
    flat = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit("<br>"))
    cell = lambda c: F.replace(strip(flat(c)), F.lit("|"), F.lit("\\|"))
    clean = F.filter(F.transform(rows, lambda r: F.transform(r, cell)), lambda r: F.exists(r, lambda c: c != ""))

    def drawn(kept: Column) -> Column:
        width = F.array_max(F.transform(kept, F.size))
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
        lines = F.concat(F.array(line(kept[0]), rule), F.transform(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), line))
        return F.when(F.size(kept) > 0, F.array_join(lines, "\n")).otherwise("")

    return bound(clean, drawn)
