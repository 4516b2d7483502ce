"""Answer scoring as Column expressions (E1-E10). No UDFs: everything stays in codegen.

Semantics follow the reference scorer: whitespace-normalised, lower-cased substring tests,
an any-number tolerance rule for numeric scalars, recall for sets and a keyword backstop for
refusals when no verdict is present.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The whitespace set of Python's ``str.isspace`` (what ``\s`` matches on text),
# spelled out so the JVM regex and SQL engines match the same characters.
PY_WHITESPACE_CLASS = (r"[\t\n\x{0B}\x{0C}\r\x{1C}\x{1D}\x{1E}\x{1F} \x{85}\x{A0}\x{1680}"
                       r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")

# The same set as characters (for trimming without a regex).
PY_WHITESPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                       + "\u2028\u2029\u202f\u205f\u3000")

# The number pattern of the scorer.
NUMBER_PATTERN = r"-?\d[\d,]*\.?\d*"

# Refusal phrases of the keyword backstop, in order.
REFUSAL_PHRASES = ["not available", "no data", "cannot", "can't", "unable", "does not", "doesn't",
                   "not found", "not in", "outside", "no information", "not contain", "unavailable"]

# Grounding markers (in the tool call's type or name; the second only in type).
GROUNDING_MARKER = "fabric"
GROUNDING_TYPE_MARKER = "mcp"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def norm(text) -> Column:
    """Collapse whitespace runs to one space, strip, lower-case; NULL -> ''."""
    collapsed = F.regexp_replace(F.coalesce(_c(text), F.lit("")), PY_WHITESPACE_CLASS, " ")
    return F.lower(F.trim(collapsed))


def extract_numbers(text) -> Column:
    """Every number-looking token, commas removed, as DOUBLE; tokens that do not parse are skipped."""
    toks = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(NUMBER_PATTERN), 0)
    vals = F.transform(toks, lambda t: F.regexp_replace(t, ",", "").try_cast("double"))
    return F.filter(vals, lambda v: v.isNotNull())


def tolerance(expected) -> Column:
    return F.greatest(F.lit(0.01), F.abs(_c(expected)) * F.lit(0.01))


def score_scalar_numeric(answer, expected) -> Column:
    """True when any number in the answer is within max(0.01, 1% of |expected|)."""
    exp = _c(expected)
    return F.exists(extract_numbers(answer), lambda v: F.abs(v - exp) <= tolerance(exp))


def matched_number(answer, expected) -> Column:
    """The first number that satisfied E3 (NULL when none)."""
    exp = _c(expected)
    return F.try_element_at(F.filter(extract_numbers(answer), lambda v: F.abs(v - exp) <= tolerance(exp)), F.lit(1))


def score_scalar_text(answer, expected) -> Column:
    """Normalised expected text is a substring of the normalised answer."""
    return F.contains(norm(answer), norm(expected))


def set_found(answer, expected_values) -> Column:
    a = norm(answer)
    return F.filter(_c(expected_values), lambda v: F.contains(a, norm(v)))


def set_missing(answer, expected_values) -> Column:
    a = norm(answer)
    return F.filter(_c(expected_values), lambda v: ~F.contains(a, norm(v)))


def set_recall(answer, expected_values) -> Column:
    """E5: share of expected members found as substrings; an empty expected set scores 1.0."""
    n = F.size(_c(expected_values))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.size(set_found(answer, expected_values)) / n)


def set_correct(answer, expected_values) -> Column:
    return set_recall(answer, expected_values) >= F.lit(0.999)


def py_strip(text) -> Column:
    """Python ``str.strip()``: Unicode whitespace removed at both ends (no regex, edges only)."""
    return F.btrim(_c(text), F.lit(PY_WHITESPACE_CHARS))


def refusal_heuristic(answer) -> Column:
    """Any refusal phrase in the normalised answer (ORed substring tests stay in generated code)."""
    a = norm(answer)
    out = F.contains(a, F.lit(REFUSAL_PHRASES[0]))
    for p in REFUSAL_PHRASES[1:]:
        out = out | F.contains(a, F.lit(p))
    return out


def score_refusal(answer, verdict) -> Column:
    """The verdict when present, else the keyword backstop."""
    return F.coalesce(_c(verdict), refusal_heuristic(answer))


def grounded(tool_calls) -> Column:
    """Any tool call whose type or name mentions the grounding marker, or whose type mentions mcp.

    The fields are pulled out of the array of structs without a lambda and joined with a control
    character that cannot join two fields into a marker, so the test stays in generated code.
    """
    calls = _c(tool_calls)
    types = F.lower(F.array_join(calls["type"], "\u0001"))
    names = F.lower(F.array_join(calls["name"], "\u0001"))
    hit = (F.contains(types, F.lit(GROUNDING_MARKER)) | F.contains(names, F.lit(GROUNDING_MARKER))
           | F.contains(types, F.lit(GROUNDING_TYPE_MARKER)))
    return F.coalesce(hit, F.lit(False))


def traversal_ok(category, grounded_col, correct) -> Column:
    """Multi-hop only: grounded AND correct; NULL for other categories."""
    return F.when(_c(category) == "multi_hop", _c(grounded_col) & _c(correct))


def task_cost(input_tokens, output_tokens, input_rate, output_rate) -> Column:
    """Dollars for one task, rounded half-even to 8 places."""
    cost = (_c(input_tokens) / F.lit(1_000_000.0)) * _c(input_rate) + (_c(output_tokens) / F.lit(1_000_000.0)) * _c(output_rate)
    return F.bround(cost, 8)


def dispatch_correct(answer_type, scalar_ok, set_ok, refusal_ok) -> Column:
    """Pick the verdict by answer type; an unknown type is an error."""
    t = _c(answer_type)
    return (F.when(t == "scalar", _c(scalar_ok)).when(t == "set", _c(set_ok)).when(t == "refusal", _c(refusal_ok))
            .otherwise(F.raise_error(F.concat(F.lit("unknown answer_type: "), F.coalesce(t, F.lit("NULL"))))))


#: columns of a per-task input that a kind of question may lack
_EXPECTED = {"error": "string", "expected_num": "double", "expected_text": "string", "expected_values": "array<string>",
             "judge_correct": "boolean"}


def score_answers(parts: list[DataFrame]) -> DataFrame:
    """E7 in full: one record per task of frames that each hold one kind of question.

    A part has the columns answer_type and answer, what its kind expects (expected_num or expected_text for
    ``scalar``, expected_values for ``set``; nothing for ``refusal``) and may have error and judge_correct; other columns are
    kept. Each part evaluates its own rule alone. Added are ``correct``, ``set_recall`` and ``detail``. A task with an error was
    not judged: its judge_correct is dropped, and its answer, or the lack of one, is scored as it is. An unknown
    answer type fails the query.
    """
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_score_part(p) for p in parts])


def _score_part(part: DataFrame) -> DataFrame:
    has = set(part.columns)
    df = part.withColumns({c: F.lit(None).cast(t) for c, t in _EXPECTED.items() if c not in has})
    df = df.withColumn("judge_correct", F.when(F.col("error").isNull(), F.col("judge_correct")))
    text = lambda c: c.cast("string")
    answer, kind = F.coalesce("answer", F.lit("")), F.col("answer_type")
    checks = []
    if has & {"expected_num", "expected_text"}:
        number, words = F.col("expected_num"), F.col("expected_text")
        df = df.withColumn("_hit", matched_number(answer, number)) if "expected_num" in has else df.withColumn("_hit", F.lit(None).cast("double"))
        found = F.concat(F.lit("found "), text(F.col("_hit")), F.lit(" within tol of "), text(number))
        lacks = F.concat(F.lit("expected "), text(number), F.lit(" not found among numbers in answer"))
        by_number = F.struct(F.col("_hit").isNotNull().alias("correct"), F.lit(None).cast("double").alias("set_recall"),
                             F.when(F.col("_hit").isNotNull(), found).otherwise(lacks).alias("detail"))
        by_text = F.struct(score_scalar_text(answer, words).alias("correct"), F.lit(None).cast("double").alias("set_recall"),
                           F.concat(F.lit("substring match for '"), words, F.lit("'")).alias("detail"))
        one = F.when(number.isNotNull(), by_number).otherwise(by_text) if {"expected_num", "expected_text"} <= has else (
            by_number if "expected_num" in has else by_text)
        checks.append(("scalar", one))
    if "expected_values" in has:
        df = df.withColumn("_missing", set_missing(answer, F.col("expected_values")))
        n = F.size("expected_values")
        df = df.withColumn("_recall", F.when(n == 0, 1.0).otherwise((n - F.size("_missing")) / n))
        lacks = F.when(F.size("_missing") > 0, F.concat(F.lit(", missing ['"), F.array_join(F.slice("_missing", 1, 5), "', '"), F.lit("']"))).otherwise("")
        checks.append(("set", F.struct((F.col("_recall") >= 0.999).alias("correct"), F.col("_recall").alias("set_recall"),
                                       F.concat(F.lit("recall "), F.format_string("%.2f", "_recall"), lacks).alias("detail"))))
    judged = F.col("judge_correct")
    checks.append(("refusal", F.struct(score_refusal(answer, judged).alias("correct"), F.lit(None).cast("double").alias("set_recall"),
                                       F.concat(F.lit("refusal: judge-primary"), F.when(judged.isNull(), " (heuristic)").otherwise("")).alias("detail"))))
    unknown = F.raise_error(F.concat(F.lit("no rule for answer_type "), F.coalesce(kind, F.lit("NULL"))))
    verdict = F.when(kind == checks[0][0], checks[0][1])
    for name, check in checks[1:]:
        verdict = verdict.when(kind == name, check)
    df = df.withColumn("_v", verdict.otherwise(unknown.cast("struct<correct: boolean, set_recall: double, detail: string>")))
    return df.withColumns({c: F.col(f"_v.{c}") for c in ("correct", "set_recall", "detail")}).drop("_v", "_hit", "_missing", "_recall")
