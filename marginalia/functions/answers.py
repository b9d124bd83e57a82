"""Prompts, answers, citations, transcripts and provider JSON as column expressions inside the JVM.

A citation is struct<n,chunk_id,source_id,title,page>; a context is an array of them in
order of n.  Nulls stay null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from marginalia.config import DEFAULT_TITLE, HISTORY_TURNS, NOT_FOUND, REINDEXING, REWRITE_EXTRA
from marginalia.functions.text import SPACE, trimmed

CITATION = "struct<n:int,chunk_id:string,source_id:string,title:string,page:int>"
_NONE = f"cast(array() as array<{CITATION}>)"
_CITED = r"\[(\d+)\]"


# --- citations ------------------------------------------------------------


def cited_numbers(answer: Column) -> Column:
    """array<int> of the numbers an answer cites, each once, ascending; numbers beyond integers are no citation."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(_CITED), F.lit(1)), lambda d: d.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda n: n.isNotNull())))


def postprocessed(answer: Column, context: Column) -> Column:
    """struct<answer,citations>: citations that the context has; the others are cut out and the gaps closed.

    A context numbered 1, 2, 3 and so on, as packing makes it, is looked up by place, so that
    thousands of citations of thousands of chunks cost no more than both are long.
    """
    known = F.transform(context, lambda c: c["n"])
    dense = F.coalesce(known == F.sequence(F.lit(1), F.size(context)), F.lit(False))
    once = F.array(F.struct(answer.alias("answer"), context.alias("context"), known.alias("known"), cited_numbers(answer).alias("cited"), dense.alias("dense")))
    return F.transform(once, _checked)[0]


def _checked(x: Column) -> Column:
    has = lambda n: F.when(x["dense"], (n >= 1) & (n <= F.size(x["context"]))).otherwise(F.array_contains(x["known"], n))
    number = lambda t: F.substring(t, 2, 20).substr(F.lit(1), F.length(t) - 2).try_cast("int")
    wrong = F.filter(F.array_distinct(F.regexp_extract_all(x["answer"], F.lit(r"\[\d+\]"), F.lit(0))), lambda t: ~F.coalesce(has(number(t)), F.lit(False)))
    text = F.aggregate(wrong, x["answer"], lambda a, t: F.replace(a, t, F.lit("")))
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r" +([.,;:!?])", "$1")
    by_place = F.transform(F.filter(x["cited"], has), lambda n: F.get(x["context"], n - 1))
    kept = F.array_sort(F.filter(x["context"], lambda c: F.array_contains(x["cited"], c["n"])))
    return F.struct(text.alias("answer"), F.when(x["dense"], by_place).otherwise(kept).alias("citations"))


def with_fallback(citations: Column, context: Column) -> Column:
    """The citations, or the whole context in order where an answer has none that holds."""
    return F.when(F.size(citations) > 0, citations).otherwise(F.array_sort(context))


def is_not_found(answer: Column) -> Column:
    return (F.coalesce(trimmed(answer), F.lit("")) == "") | answer.rlike("(?iu)không tìm thấy")


def decided(raw: Column, mode: Column, context: Column, reindexing: Column) -> Column:
    """struct<decision,answer,citations> of what a model said.

    While the index is built anew there is no answer; without context only the open mode
    answers.  A grounded answer is kept with what it cites, or with the whole context as
    citations if it cites nothing, unless it says that it found nothing.
    """
    done = postprocessed(raw, context)
    open_, cites = mode == "open", F.size(done["citations"]) > 0
    missing = ~open_ & ((F.size(context) == 0) | (~cites & is_not_found(done["answer"])))
    decision = F.when(reindexing, "reindexing").when(missing, "not-found").otherwise(mode)
    text = F.when(reindexing, REINDEXING).when(missing, NOT_FOUND).otherwise(done["answer"])
    found = F.when(reindexing | missing, F.expr(_NONE)).when(open_, done["citations"]).otherwise(with_fallback(done["citations"], context))
    return F.struct(decision.alias("decision"), text.alias("answer"), found.alias("citations"))


def citation_label(c: Column) -> Column:
    page = F.when(c["page"].isNotNull(), F.concat(F.lit(" · trang "), c["page"].cast("string"))).otherwise("")
    return F.concat(F.lit("["), c["n"].cast("string"), F.lit("] "), F.coalesce(c["title"], F.lit(DEFAULT_TITLE)), page)


def answer_markdown(content: Column, citations: Column) -> Column:
    body = F.regexp_replace(content, f"{SPACE}+$", "")
    listed = F.concat(body, F.lit("\n\n---\n\nNguồn:\n"), F.array_join(F.transform(citations, citation_label), "\n"), F.lit("\n"))
    return F.when(F.coalesce(F.size(citations), F.lit(0)) <= 0, F.concat(body, F.lit("\n"))).otherwise(listed)


def display_parts(text: Column) -> Column:
    """array<string>: a text cut before and behind each citation of one to six digits."""
    marked = F.regexp_replace(text, r"(\[\d{1,6}\])", "\u0001$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda x: x != "")


def citations_json(citations: Column) -> Column:
    return F.to_json(F.coalesce(citations, F.expr(_NONE)))


def citations_of(json: Column) -> Column:
    """Citations read back; what is no array of them is none."""
    return F.when(trimmed(json).startswith("["), F.coalesce(F.from_json(json, f"array<{CITATION}>"), F.expr(_NONE))).otherwise(F.expr(_NONE))


# --- prompts --------------------------------------------------------------

# What the models are told.
_RULES = {
    "grounded": (
        "Bạn là trợ lý trả lời CHỈ dựa trên các đoạn nguồn được đánh số [n] dưới đây.",
        f'Khi dùng thông tin từ đoạn nào, chèn đúng [n] ngay sau ý đó — KỂ CẢ khi tóm tắt (mỗi ý tóm tắt phải kèm [n] của đoạn tương ứng). Nếu các đoạn không chứa câu trả lời, trả lời đúng một câu: "{NOT_FOUND}".',
        "Tuyệt đối KHÔNG dùng kiến thức ngoài các đoạn này, KHÔNG bịa.",
    ),
    "open": (
        "Bạn là trợ lý trả lời câu hỏi. Ưu tiên trả lời từ các đoạn nguồn được đánh số [n] dưới đây, chèn [n] cho phần lấy từ nguồn.",
        'Nếu cần dùng kiến thức chung NGOÀI các đoạn, được phép, nhưng ghi rõ phần đó bằng cụm "(không dựa trên nguồn)" và KHÔNG gắn [n] cho phần đó.',
    ),
}


def system_prompt(mode: Column, context: Column) -> Column:
    """What a model is told before a question; ``context`` is the packed text."""
    text = lambda m: F.concat(F.lit("\n".join([*_RULES[m], "", "--- CÁC ĐOẠN NGUỒN ---", ""])), context, F.lit("\n--- HẾT ĐOẠN NGUỒN ---"))
    return F.when(mode == "grounded", text("grounded")).otherwise(text("open"))


def last_turns(history: Column) -> Column:
    """The turns of a conversation that count for the next question."""
    return F.slice(history, F.greatest(F.size(history) - HISTORY_TURNS + 1, F.lit(1)), HISTORY_TURNS)


def rewrite_prompt(question: Column, history: Column) -> Column:
    """The user's part of the prompt that makes a follow-up question stand alone; of ``history`` the last turns count."""
    said = F.transform(last_turns(history), lambda t: F.concat(F.when(t["role"] == "user", "Người dùng").otherwise("Trợ lý"), F.lit(": "), t["content"]))
    before = F.when(F.coalesce(F.size(history), F.lit(0)) > 0, F.array_join(said, "\n")).otherwise("(chưa có hội thoại trước)")
    return F.concat(F.lit("Hội thoại trước:\n"), before, F.lit("\n\nCâu hỏi cần viết lại:\n"), question, F.lit("\n\nTruy vấn viết lại:"))


def rewritten(question: Column, said: Column) -> Column:
    """The question as a model has rewritten it; the question itself where that is blank, missing or far too long."""
    clean = trimmed(F.regexp_replace(trimmed(said), "^[\"'“”]+|[\"'“”]+$", ""))
    return F.when(clean.isNull() | (clean == "") | (F.length(clean) > F.length(question) + REWRITE_EXTRA), question).otherwise(clean)


# --- transcripts ----------------------------------------------------------


def transcript(segments: Column) -> Column:
    """struct<text,map> of array<struct<text,...>>: texts squeezed, blank ones dropped, one space between.

    ``map`` has each segment's other fields with its place in the text (s, e).
    """
    squeezed = F.filter(F.transform(segments, lambda x: F.struct(trimmed(F.regexp_replace(x["text"], f"{SPACE}+", " ")).alias("t"), x.alias("x"))), lambda x: F.coalesce(x["t"], F.lit("")) != "")
    entry = lambda at, x: F.struct(at.alias("s"), (at + F.length(x["t"])).alias("e"), x["x"].alias("of"))
    none = F.slice(F.transform(squeezed, lambda x: entry(F.lit(0), x)), 1, 0)

    def add(state: Column, x: Column) -> Column:
        """One pass: each segment starts where the one before it ends."""
        return F.struct((state["at"] + F.length(x["t"]) + 1).alias("at"), F.concat(state["map"], F.array(entry(state["at"], x))).alias("map"))

    placed = F.aggregate(squeezed, F.struct(F.lit(0).alias("at"), none.alias("map")), add, lambda s: s["map"])
    return F.struct(F.array_join(F.transform(squeezed, lambda x: x["t"]), " ").alias("text"), placed.alias("map"))


def _overlapping(entries: Column, start: Column, end: Column) -> Column:
    return F.filter(entries, lambda e: ~((e["e"] <= start) | (e["s"] >= end)))


def time_of(entries: Column, start: Column, end: Column) -> Column:
    """struct<t_start,t_end> of the map entries (s, e, of.t_start, of.t_end) that a range overlaps; null if there is none."""
    hit = _overlapping(entries, start, end)
    return F.when(F.size(hit) > 0, F.struct(F.array_min(F.transform(hit, lambda e: e["of"]["t_start"])).alias("t_start"), F.array_max(F.transform(hit, lambda e: e["of"]["t_end"])).alias("t_end")))


def unit_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """struct<x,y,w,h> of a box in shares of its image, 0 to 1; an image without size counts as one unit wide."""
    w, h = F.when(width > 0, width).otherwise(1), F.when(height > 0, height).otherwise(1)
    share = lambda a: F.least(F.greatest(a.cast("double"), F.lit(0.0)), F.lit(1.0))
    return F.struct(share(x0 / w).alias("x"), share(y0 / h).alias("y"), share((x1 - x0) / w).alias("w"), share((y1 - y0) / h).alias("h"))


def box_of(entries: Column, start: Column, end: Column) -> Column:
    """struct<x,y,w,h> around the boxes of the map entries (s, e, of.box) that a range overlaps; null if there is none."""
    boxes = F.transform(_overlapping(entries, start, end), lambda e: e["of"]["box"])
    low = lambda k: F.array_min(F.transform(boxes, lambda b: b[k]))
    high = lambda k, n: F.array_max(F.transform(boxes, lambda b: b[k] + b[n]))
    return F.when(F.size(boxes) > 0, F.struct(low("x").alias("x"), low("y").alias("y"), (high("x", "w") - low("x")).alias("w"), (high("y", "h") - low("y")).alias("h")))


def flat_lines(blocks: Column) -> Column:
    """Lines of array<struct<paragraphs:array<struct<lines:array<struct<text,...>>>>>> whose text is not blank, in order."""
    empty = lambda c, kind: F.coalesce(c, F.expr(f"cast(array() as {kind})")) if kind else c
    lines = F.flatten(F.transform(F.flatten(F.transform(blocks, lambda b: empty(b["paragraphs"], ""))), lambda p: p["lines"]))
    return F.filter(lines, lambda x: F.coalesce(trimmed(x["text"]), F.lit("")) != "")


def resampled(samples: Column, rate: Column, target: int = 16_000) -> Column:
    """array<double> at ``target`` samples a second by linear interpolation; none for a rate or an array without length."""
    n = F.greatest(F.lit(1), F.floor(F.size(samples) * (F.lit(float(target)) / rate) + 0.5)).cast("int")

    def at(k: Column) -> Column:
        pos = k * rate / float(target)
        i = F.floor(pos).cast("int")
        a, b = F.get(samples, i).cast("double"), F.get(samples, F.least(i + 1, F.size(samples) - 1)).cast("double")
        return a * (1 - (pos - i)) + b * (pos - i)

    same = F.transform(samples, lambda x: x.cast("double"))
    fits = (rate > 0) & (F.size(samples) > 0)
    return F.when(rate == target, same).when(fits, F.transform(F.sequence(F.lit(0), F.when(fits, n).otherwise(1) - 1), at)).otherwise(F.expr("cast(array() as array<double>)"))


# --- provider JSON --------------------------------------------------------


def request_body(messages: Column, dialect: str, model: Column, max_tokens: int = 4096) -> Column:
    """JSON of array<struct<role,content>> as a provider takes it: blocks, parts or choices."""
    if dialect == "choices":
        return F.to_json(F.struct(model.alias("model"), F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages")))
    system = F.nullif(F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: m["content"]), "\n\n"), F.lit(""))
    turns = F.filter(messages, lambda m: m["role"] != "system")
    role = lambda m, other: F.when(m["role"] == "assistant", other).otherwise("user").alias("role")
    if dialect == "blocks":
        said = F.transform(turns, lambda m: F.struct(role(m, "assistant"), m["content"].alias("content")))
        return F.to_json(F.struct(model.alias("model"), F.lit(max_tokens).alias("max_tokens"), said.alias("messages"), system.alias("system")))
    said = F.transform(turns, lambda m: F.struct(role(m, "model"), F.array(F.struct(m["content"].alias("text"))).alias("parts")))
    instruction = F.when(system.isNotNull(), F.struct(F.array(F.struct(system.alias("text"))).alias("parts")))
    return F.to_json(F.struct(said.alias("contents"), instruction.alias("systemInstruction")))


def _strings(values: Column, path: str, keep=None) -> Column:
    """String fields of variants, joined."""
    found = F.filter(values, lambda v: keep(v)) if keep else values
    text = lambda v: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    return F.coalesce(F.array_join(F.filter(F.transform(found, text), lambda t: t.isNotNull()), ""), F.lit(""))


def response_text(json: Column, dialect: str) -> Column:
    """What a model said, from a provider's whole answer; empty where the JSON has no text."""
    found = F.try_parse_json(json)
    if dialect == "choices":
        return _strings(F.array(F.try_variant_get(found, "$.choices[0]", "variant")), "$.message.content")
    if dialect == "blocks":
        return _strings(F.try_variant_get(found, "$.content", "array<variant>"), "$.text", lambda v: F.coalesce(F.try_variant_get(v, "$.type", "string") == "text", F.lit(False)))
    return _strings(F.try_variant_get(found, "$.candidates[0].content.parts", "array<variant>"), "$.text")


def model_list(json: Column) -> Column:
    """array<struct<name,size,kind>> of a local runtime's list; empty for what is no such list."""
    found = F.from_json(json, "struct<models:array<struct<name:string,size:bigint>>>")["models"]
    kind = lambda n: F.when(n.rlike("(?i)embed"), "embedding").otherwise("chat")
    return F.coalesce(F.transform(found, lambda m: F.struct(m["name"].alias("name"), m["size"].alias("size"), kind(m["name"]).alias("kind"))), F.expr("cast(array() as array<struct<name:string,size:bigint,kind:string>>)"))


ONLINE = ("anthropic", "gemini", "openai")  # fixed values: known providers


def online_config(json: Column) -> Column:
    """struct<active,models> of a stored setting; unknown providers and malformed model names become null."""
    raw = F.from_json(json, "struct<activeOnlineId:string,models:map<string,string>>")
    name = lambda c: F.when(c.rlike(r"^\w[\w.:/-]{0,199}\z"), c)
    models = F.struct(*(name(F.try_element_at(raw["models"], F.lit(p))).alias(p) for p in ONLINE))
    return F.struct(F.when(raw["activeOnlineId"].isin(*ONLINE), raw["activeOnlineId"]).alias("active"), models.alias("models"))


# Fields whose content is never logged.
_PRIVATE = ("text", "content", "body", "document", "query", "answer", "apiKey", "token")


def redacted(fields: Column) -> Column:
    """A map<string,string> with the values of private fields replaced."""
    return F.transform_values(fields, lambda k, v: F.when(k.isin(*_PRIVATE), "[REDACTED]").otherwise(v))


def redacted_deep(value: Column, kind: DataType) -> Column:
    """A value of a nested type with every private field replaced, however deep it lies in structs, arrays and maps."""
    hidden = F.lit("[REDACTED]")
    if isinstance(kind, StructType):
        fields = [(hidden if f.name in _PRIVATE else redacted_deep(value[f.name], f.dataType)).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: redacted_deep(x, kind.elementType))
    if isinstance(kind, MapType) and isinstance(kind.valueType, StringType):
        return redacted(value)
    if isinstance(kind, MapType):
        return F.transform_values(F.map_filter(value, lambda k, v: ~k.isin(*_PRIVATE)), lambda k, v: redacted_deep(v, kind.valueType))
    return value
