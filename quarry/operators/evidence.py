"""Evidence packing: rows -> bounded CSV text per question.

Typed path first: columns are dropped from the DataFrame *before* the CSV text is built, so
Catalyst prunes them from the scan. The text path (``project_csv_text``) handles blocks that
arrive as text. Blocks are capped per question with a top-k window (partial WindowGroupLimit
before the shuffle) and totals come from a grouped count, so only ``cap`` blocks per question are
ever gathered into one row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scoring import PY_WHITESPACE_CLASS, py_strip
from quarry.operators.order_stats import join_same, rank_within_groups, top_k_per_group

# The text layout of the composed model input (section headers and notices).
HEAD_QUESTION = "# Question"
HEAD_EVIDENCE = "# Grounded ontology evidence (AUTHORITATIVE — answer ONLY from this)"
ERROR_PREFIX = "RETRIEVAL ERROR: "
ERROR_TAIL = "NO ROWS were returned. You must reply that the data is unavailable."
NO_ROWS_1 = "NO ROWS were returned for this question."
NO_ROWS_2 = "You must reply that the data is unavailable; do NOT fabricate an answer."
HEAD_SUMMARY = "## Retrieval summary"
HEAD_ROWS = "## Verbatim rows (CSV)"
REF_HEADER = "### reference "
NOTE_HEADER = "### note"
NOTE_TAIL = " references shown (older/less-relevant rows omitted)."

# Defaults of the injection config (partial edits are overlaid on these).
INJECTION_DEFAULTS = {"include_synthesized_answer": "true", "max_rows": None, "drop_columns": "",
                      "max_row_chars": None}

_WS_EDGES = f"^{PY_WHITESPACE_CLASS}|{PY_WHITESPACE_CLASS}$"
_NON_WS = "[^" + PY_WHITESPACE_CLASS[1:-2] + "]"


def strip(c: Column) -> Column:
    """Python ``str.strip()`` (Unicode whitespace at both ends)."""
    return py_strip(c)


def has_text(c: Column) -> Column:
    """H5 per block: holds a non-whitespace character."""
    return F.coalesce(c.rlike(_NON_WS), F.lit(False))


def csv_cell(c: Column) -> Column:
    """Minimal CSV quoting: quote cells holding a comma, quote or line break; NULL -> empty."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    needs = s.rlike('[,"\r\n]')
    return F.when(needs, F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_block(columns: list[tuple[str, Column]]) -> Column:
    """Header line + one data line for the given (name, value) cells."""
    header = ",".join(n for n, _ in columns)
    return F.concat(F.lit(header + "\n"), F.concat_ws(",", *[csv_cell(v) for _, v in columns]))


ORDER_CELLS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "notes"]


def order_cells(orders: DataFrame) -> list[tuple[str, Column]]:
    return [("o_orderkey", F.col("o_orderkey").cast("string")), ("o_orderstatus", F.col("o_orderstatus")),
            ("o_totalprice", F.format_string("%.2f", F.col("o_totalprice"))),
            ("o_orderpriority", F.col("o_orderpriority")),
            ("notes", F.concat(F.col("o_orderpriority"), F.lit(", status "), F.col("o_orderstatus")))]


def order_blocks(catalog, drop: list[str] | None = None) -> DataFrame:
    """H1 typed path: one block per order (question = its customer), dropped columns never built."""
    drop = set(drop or [])
    o = catalog.orders
    cells = [(n, c) for n, c in order_cells(o) if n not in drop]
    return o.select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("ref_no"),
                    csv_block(cells).alias("block"))


def order_block_variants(catalog, variants: dict[str, list[str]]) -> DataFrame:
    """Several projections of each order's block from one scan: ``{column: dropped names}``."""
    o = catalog.orders
    cells = order_cells(o)
    return o.select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("ref_no"),
                    *[csv_block([(n, c) for n, c in cells if n not in set(drop)]).alias(name)
                      for name, drop in variants.items()])


def project_csv_text(raw: Column, drop: list[str]) -> Column:
    """H1 text path: drop named columns from a CSV block held as text.

    The whole block is read with RFC 4180 quotes (cells may hold commas, quotes and line breaks) and
    any number of fields, in Arrow batches; kept positions come from the block's own header; unknown
    names are ignored, short rows keep the cells they have, trailing line breaks go. Nothing to drop,
    an empty or a NULL block: the block as it is.
    """
    if not drop:
        return raw
    unwanted = set(drop)

    @F.pandas_udf("string")
    def project(blocks: pd.Series) -> pd.Series:
        import csv
        import io

        csv.field_size_limit(1 << 30)

        def one(block):
            rows = csv.reader(io.StringIO(block, newline=""))
            header = next(rows, None)
            if header is None:
                return block
            keep = [i for i, name in enumerate(header) if name not in unwanted]
            out = io.StringIO()
            put = csv.writer(out, lineterminator="\n")
            put.writerow([header[i] for i in keep])
            for cells in rows:
                put.writerow([cells[i] for i in keep if i < len(cells)])
            return out.getvalue().rstrip("\n")

        return blocks.map(one, na_action="ignore")

    return project(raw)


def cap_blocks(blocks: DataFrame, cap: int | None, key: str = "question_id", order: str = "ref_no",
               totals: DataFrame | None = None) -> DataFrame:
    """H2: keep the first ``cap`` blocks per question (block order), numbered 1..shown, with the total."""
    if totals is None:
        totals = blocks.groupBy(key).agg(F.count(F.lit(1)).alias("n_total"))
    if cap is None:
        ranked = rank_within_groups(blocks, [key], [F.col(order)], "shown_no")
    else:
        ranked = top_k_per_group(blocks, [key], [F.col(order)], cap, "shown_no")
    return join_same(ranked, totals, [key])


def truncate(block: Column, max_chars: int | None) -> Column:
    """H3: first ``max_chars`` characters."""
    return block if max_chars is None else F.substring(block, 1, max_chars)


def compose_inputs(questions: DataFrame, blocks: DataFrame, *, include_summary: bool = True,
                   max_rows: int | None = None, max_row_chars: int | None = None,
                   key: str = "question_id") -> DataFrame:
    """H4: the model input per question.

    ``questions``: key, question, error, summary. ``blocks``: key, ref_no, block (already
    projected). Output: key, text, n_total, n_shown, has_rows. Without ``max_rows`` a question's whole
    text is one row: ``compose_chunks`` gives it in rows of bounded length.
    """
    # one grouped pass over all blocks: the total and whether any block has text (has_rows looks
    # at every block, not only the shown ones)
    stats = blocks.groupBy(key).agg(F.count(F.lit(1)).alias("n_total"),
                                    F.max(has_text(F.col("block"))).alias("has_rows"))
    shown = blocks.withColumn("block", truncate(strip(F.col("block")), max_row_chars))
    if max_rows is None:
        capped = rank_within_groups(shown, [key], [F.col("ref_no")], "shown_no")
    else:
        capped = top_k_per_group(shown, [key], [F.col("ref_no")], max_rows, "shown_no")
    per_q = capped.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("shown_no", "block"))).alias("_blocks"),
        F.count(F.lit(1)).alias("n_shown"))
    q = questions.join(per_q, key, "left").join(stats, key, "left")
    refs = F.flatten(F.transform(F.coalesce(F.col("_blocks"), F.array().cast("array<struct<shown_no:int,block:string>>")),
                                 lambda b: F.array(F.concat(F.lit(REF_HEADER), b["shown_no"].cast("string")), b["block"])))
    note = (F.when(F.lit(max_rows is not None) & (F.col("n_total") > F.col("n_shown")),
                   F.array(F.lit(NOTE_HEADER), F.concat(F.col("n_shown").cast("string"), F.lit(" of "),
                                                        F.col("n_total").cast("string"), F.lit(NOTE_TAIL))))
            .otherwise(F.array().cast("array<string>")))
    lines = F.when(_shows_rows(), F.concat(_opening(include_summary), refs, note)).otherwise(_opening(include_summary))
    return q.select(key, F.array_join(lines, "\n").alias("text"),
                    F.coalesce("n_total", F.lit(0)).alias("n_total"), F.coalesce("n_shown", F.lit(0)).alias("n_shown"),
                    F.coalesce("has_rows", F.lit(False)).alias("has_rows"))


def _shows_rows() -> Column:
    return F.col("error").isNull() & F.coalesce("has_rows", F.lit(False))


def _opening(include_summary: bool) -> Column:
    """The lines before the first reference; without references, all lines."""
    head = F.array(F.lit(HEAD_QUESTION), F.col("question"), F.lit(""), F.lit(HEAD_EVIDENCE))
    err = F.array(F.concat(F.lit(ERROR_PREFIX), F.col("error")), F.lit(ERROR_TAIL))
    none = F.array(F.lit(NO_ROWS_1), F.lit(NO_ROWS_2))
    summary = (F.when(F.lit(include_summary) & (F.coalesce(F.length("summary"), F.lit(0)) > 0),
                      F.array(F.lit(HEAD_SUMMARY), F.col("summary"), F.lit("")))
               .otherwise(F.array().cast("array<string>")))
    body = F.when(F.col("error").isNotNull(), err).when(~_shows_rows(), none).otherwise(F.concat(summary, F.array(F.lit(HEAD_ROWS))))
    return F.concat(head, body)


def compose_chunks(questions: DataFrame, blocks: DataFrame, *, include_summary: bool = True,
                   max_row_chars: int | None = None, chunk_chars: int = 1 << 20, key: str = "question_id") -> DataFrame:
    """H4 without a cap: the text that ``compose_inputs(max_rows=None)`` gives, in numbered chunks.

    Output: key, chunk_no (from 0), text of ``chunk_chars`` characters (the last chunk: what is left); the
    chunks of a question in order are its text. ``ref_no`` must be unique within a question. No row is
    longer than a chunk or a block: references are numbered across tasks, the place of each comes from
    sums of lengths over 4,096 references, over 4,096 such sums and so on, and each is cut at the
    chunk borders. A question without blocks has its opening alone; blocks of no question are left out.
    """
    stats = blocks.groupBy(key).agg(F.max(has_text(F.col("block"))).alias("has_rows"))
    asked = questions.join(stats, key, "left")
    opening = asked.select(key, F.array_join(_opening(include_summary), "\n").alias("piece"), _shows_rows().alias("_rows"))
    # what follows an opening starts at its length
    shown = (blocks.select(key, "ref_no", truncate(strip(F.col("block")), max_row_chars).alias("block"))
             .join(opening.where("_rows").select(key, F.length("piece").cast("long").alias("_from")), key))
    refs = rank_within_groups(shown, [key], [F.col("ref_no")], "no").withColumn("no", F.col("no").cast("long"))
    text = F.concat(F.lit("\n" + REF_HEADER), F.col("no").cast("string"), F.coalesce(F.concat(F.lit("\n"), F.col("block")), F.lit("")))
    refs = refs.select(key, "no", "_from", text.alias("piece"), F.length(text).cast("long").alias("_len"))
    refs = _starts(refs, key).select(key, "no", "piece", (F.col("_from") + F.col("_start")).alias("_start"))
    pieces = opening.select(key, F.lit(0).cast("long").alias("no"), "piece", F.lit(0).cast("long").alias("_start")).unionByName(refs)

    size = F.lit(chunk_chars).cast("long")
    last = F.expr(f"(_start + greatest(length(piece), 1) - 1) div {chunk_chars}")
    cut = pieces.select("*", F.explode(F.sequence(F.expr(f"_start div {chunk_chars}"), last)).alias("chunk_no"))
    begin = F.greatest(F.col("chunk_no") * size - F.col("_start"), F.lit(0))
    upto = (F.col("chunk_no") + 1) * size - F.col("_start")
    cut = cut.select(key, "chunk_no", "no", F.col("piece").substr((begin + 1).cast("int"), F.least(upto - begin, size).cast("int")).alias("part"))
    # at most chunk_chars parts of a character or more
    parts = cut.groupBy(key, "chunk_no").agg(F.array_sort(F.collect_list(F.struct("no", "part"))).alias("_parts"))
    return parts.select(key, "chunk_no", F.array_join(F.col("_parts.part"), "").alias("text"))


def _starts(refs: DataFrame, key: str, bits: int = 12, levels: int = 3) -> DataFrame:
    """``_start``: sum of ``_len`` over the earlier ``no`` of the key. Sums are taken over runs of 2**bits rows, level
    by level, so that no window holds more (the last: one row for 2**36 references)."""
    def running(df: DataFrame, at: str, group: str) -> DataFrame:
        w = Window.partitionBy(key, group).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("_before", F.coalesce(F.sum("_len").over(w), F.lit(0)))

    sums, at, offsets = refs, "no", []
    for level in range(1, levels + 1):
        group = f"_g{level}"
        sums = sums.withColumn(group, F.shiftright(F.col("no"), bits * level))
        if level > 1:
            sums = sums.groupBy(key, at, group).agg(F.sum("_len").alias("_len"), F.min("no").alias("no"))
            offsets.append(running(sums, at, group).select(key, at, group, F.col("_before").alias(f"_b{level}")))
        at = group
    top = sums.groupBy(key, at).agg(F.sum("_len").alias("_len")).withColumn("_all", F.lit(0))
    offsets.append(running(top, at, "_all").select(key, at, F.col("_before").alias("_btop")))
    # from the coarsest level down, small sides joined to small sides; the references meet one row per run
    total = offsets.pop().withColumnRenamed("_btop", "_off")
    for o in reversed(offsets):
        level_at, group, before = o.columns[1:]
        total = o.join(total, [key, group]).select(key, level_at, (F.col(before) + F.col("_off")).alias("_off"))
    here = running(refs.withColumn("_g1", F.shiftright(F.col("no"), bits)), "no", "_g1")
    return here.join(total, [key, "_g1"]).withColumn("_start", F.col("_before") + F.col("_off")).drop("_g1", "_before", "_off")


def customer_questions(catalog) -> DataFrame:
    """One question per customer; every 97th retrieval failed, every 2nd carries a summary."""
    c = catalog.customer.select("c_custkey", "c_name")
    return c.select(F.col("c_custkey").alias("question_id"),
                    F.concat(F.lit("Which orders did "), F.col("c_name"), F.lit(" place?")).alias("question"),
                    F.when(F.col("c_custkey") % 97 == 0, F.lit("HTTP 500: upstream timeout")).alias("error"),
                    F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Orders of "), F.col("c_name"),
                                                                  F.lit(" follow."))).alias("summary"))


# --- H6: nested retrieve responses --------------------------------------------------------------

# Field names of the retrieve response format (raw CSV rows, synthesized answer).
RAW_FIELD = "fabricRawData"
ANSWER_FIELD = "fabricAnswer"

RESPONSE_SCHEMA = (f"struct<references: array<struct<sourceData: struct<{RAW_FIELD}: string, {ANSWER_FIELD}: string>>>, "
                   "response: array<struct<content: array<struct<type: string, text: string>>>>>")


_ODD_CONTROLS = "[\\x0B\\x0E\\x0F\\x1A-\\x1F]"


def json_string(c: Column) -> Column:
    """Quote text as a JSON string literal: backslash, quote and all control characters below 0x20.

    The literal is cut out of ``to_json``; only text with a control character whose code has a hex letter
    (written in small letters here) goes through a chain of replacements instead.
    """
    whole = F.to_json(F.struct(c.cast("string").alias("v")))
    plain = F.rtrim(F.substring(whole, 6, (1 << 31) - 1), F.lit("}"))
    return F.when(c.rlike(_ODD_CONTROLS), _spelled_out(c)).when(c.isNotNull(), plain)


def _spelled_out(c: Column) -> Column:
    def escape(x: Column) -> Column:
        s = F.replace(x, F.lit("\\"), F.lit("\\\\"))
        short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r", 34: '\\"'}
        for code in [*range(0x20), 34]:
            s = F.replace(s, F.lit(chr(code)), F.lit(short.get(code, f"\\u{code:04x}")))
        return F.concat(F.lit('"'), s, F.lit('"'))

    return F.element_at(F.transform(F.array(c), escape), 1)  # one name for the text, whatever its expression


def order_responses(catalog) -> DataFrame:
    """A retrieve response per order: its block as raw data, an answer reference for two of three
    orders, an empty raw block for every tenth, and a text message as the fallback answer."""
    o = catalog.orders
    raw = F.when(F.col("o_orderkey") % 10 == 0, F.lit("")).otherwise(csv_block(order_cells(o)))
    answer_ref = F.when(F.col("o_orderkey") % 3 != 0, F.concat(
        F.lit(', {"sourceData": {"' + ANSWER_FIELD + '": '),
        json_string(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" is "), F.col("o_orderstatus"))),
        F.lit("}}"))).otherwise(F.lit(""))
    doc = F.concat(F.lit('{"references": [{"sourceData": {"' + RAW_FIELD + '": '), json_string(raw), F.lit("}}"), answer_ref,
                   F.lit('], "response": [{"content": [{"type": "text", "text": '),
                   json_string(F.concat(F.lit("Priority "), F.col("o_orderpriority"))), F.lit("}]}]}"))
    return o.select(F.col("o_orderkey").alias("response_id"), doc.alias("body"))


def extract_references(responses: DataFrame, body: str = "body") -> DataFrame:
    """H6: blocks (non-empty raw data, in order) and the first answer (else the first text content)."""
    # parsed in a projection of its own: once, not once an output column
    responses = responses.select("response_id", F.from_json(F.col(body), RESPONSE_SCHEMA).alias("_parsed"))
    p = F.col("_parsed")
    refs = p["references"]
    # field extraction from the array of structs + compact/remove: no lambdas on the main path
    blocks = F.coalesce(F.array_remove(F.array_compact(refs["sourceData"][RAW_FIELD]), ""),
                        F.array().cast("array<string>"))
    answers = F.array_remove(F.array_compact(refs["sourceData"][ANSWER_FIELD]), "")
    texts = F.filter(F.flatten(F.transform(F.coalesce(p["response"], F.array().cast(
        "array<struct<content: array<struct<type: string, text: string>>>>")),
        lambda m: F.coalesce(m["content"], F.array().cast("array<struct<type: string, text: string>>")))),
        lambda c: (c["type"] == "text") & c["text"].isNotNull() & (F.length(c["text"]) > 0))
    return responses.select("response_id", F.coalesce(F.size(refs), F.lit(0)).alias("n_refs"),
                            blocks.alias("blocks"),
                            F.coalesce(F.try_element_at(answers, F.lit(1)),
                                       F.try_element_at(texts, F.lit(1))["text"]).alias("synthesized"))


# --- H7, H9: config overlay and fingerprint -----------------------------------------------------

def overlay_config(edit_json: Column) -> Column:
    """H7: defaults overlaid by the known keys of a partial JSON edit (unknown keys ignored).

    Overridden defaults are removed before the two maps are concatenated, so no duplicate keys
    arise and no session setting is needed."""
    defaults = F.create_map(*[x for k, v in INJECTION_DEFAULTS.items() for x in (F.lit(k), F.lit(v).cast("string"))])
    edit = F.coalesce(F.from_json(edit_json, "map<string,string>"), F.create_map().cast("map<string,string>"))
    known = F.map_filter(edit, lambda k, v: F.array_contains(F.map_keys(defaults), k))
    kept = F.map_filter(defaults, lambda k, v: ~F.array_contains(F.map_keys(known), k))
    return F.map_concat(kept, known)


def resolved_config(df: DataFrame, edit_col: str) -> DataFrame:
    m = overlay_config(F.col(edit_col))
    return df.select("*", *[m[k].alias(k) for k in INJECTION_DEFAULTS])


def canonical_json(fields: list[tuple[str, Column, str]]) -> Column:
    """JSON object text like Python ``json.dumps(sort_keys=True, ensure_ascii=False)``.

    ``fields``: (key, value, kind) with kind ``str`` or ``str_array``; a NULL value omits the key.
    """
    parts = []
    for k, v, kind in sorted(fields, key=lambda f: f[0]):
        if kind == "str":
            val = json_string(v)
        else:
            val = F.concat(F.lit("["), F.array_join(F.transform(v, json_string), ", "), F.lit("]"))
        parts.append(F.when(v.isNotNull(), F.concat(json_string(F.lit(k)), F.lit(": "), val)))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def config_fingerprint(fields: list[tuple[str, Column, str]]) -> Column:
    """H9: SHA-256 of the canonical JSON; optional parts only when present."""
    return F.sha2(canonical_json(fields), 256)


def header_has(block: Column, column: str) -> Column:
    """The block's header line lists ``column``."""
    return F.array_contains(F.split(F.element_at(F.split(block, "\n"), 1), ","), column)
