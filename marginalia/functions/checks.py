"""Checks, lookups and labels as column expressions; all run inside the JVM.

A check gives the message of what is wrong, or null.  Nulls count as missing values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia import config as C
from marginalia.functions.text import trimmed


def mapped(key: Column, table: dict[str, object]) -> Column:
    """Value of a small fixed table; null for other keys."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


# --- files ----------------------------------------------------------------


def extension(path: Column) -> Column:
    """What follows the last dot, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))


def kind_of(path: Column) -> Column:
    """Kind of a source by its last extension; null where there is no reader."""
    return mapped(F.lower(F.substring_index(path, ".", -1)), C.KINDS)


def title_of(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def media_type(ext: Column) -> Column:
    return F.coalesce(mapped(F.lower(ext), C.MEDIA_TYPES), F.lit("audio/mpeg"))


def within_limit(kind: Column, size: Column) -> Column:
    """Whether a source of ``size`` bytes may be read; null for an unknown kind."""
    return size <= mapped(kind, C.SIZE_LIMITS)


def source_error(notebook_id: Column, kind: Column, origin: Column) -> Column:
    """What is wrong with a source that is to be added."""
    url_like = trimmed(origin).rlike("(?i)^[a-z][a-z0-9+.-]*://")
    no_origin = F.coalesce(trimmed(origin), F.lit("")) == ""
    return (
        F.when(F.coalesce(notebook_id, F.lit("")) == "", C.SOURCE_ERRORS["notebook"])
        .when(no_origin, C.SOURCE_ERRORS["origin"])
        .when((kind != "url") & url_like, C.SOURCE_ERRORS["scheme"])
    )


def empty_error(kind: Column, pages: Column) -> Column:
    """Error label of a source whose cleaned pages are all empty; videos and images may be."""
    none = F.size(F.filter(F.coalesce(pages, F.expr("cast(array() as array<string>)")), lambda p: F.length(p) > 0)) == 0
    return F.when(none & ~kind.isin("video", "image"), error_label(F.lit("parse"), kind))


# --- questions and names --------------------------------------------------


def question_error(question: Column) -> Column:
    n = F.length(trimmed(question))
    return F.when(question.isNull(), C.QUESTION_ERRORS["type"]).when(n == 0, C.QUESTION_ERRORS["empty"]).when(n > C.QUESTION_LEN, C.QUESTION_ERRORS["long"])


def mode_error(mode: Column) -> Column:
    """A mode that is not known is refused, never replaced."""
    return F.when(~F.coalesce(mode.isin("grounded", "open"), F.lit(False)), C.QUESTION_ERRORS["mode"])


def history_error(history: Column) -> Column:
    """``history`` is array<struct<role,content>>; null is no history."""
    good = F.forall(history, lambda t: F.coalesce(t["role"].isin("user", "assistant") & (F.length(t["content"]) <= C.HISTORY_LEN), F.lit(False)))
    return F.when(F.size(history) > C.HISTORY_ITEMS, C.QUESTION_ERRORS["history-long"]).when(history.isNotNull() & ~good, C.QUESTION_ERRORS["history"])


def name_error(name: Column) -> Column:
    n = F.length(trimmed(F.coalesce(name, F.lit(""))))
    return F.when(n == 0, C.NAME_ERRORS["empty"]).when(n > C.NAME_LEN, C.NAME_ERRORS["long"])


def color_error(color: Column) -> Column:
    return F.when(~F.coalesce(color.isin(*C.PALETTE), F.lit(False)), C.NAME_ERRORS["color"])


def id_error(id_: Column) -> Column:
    return F.when(F.coalesce(id_, F.lit("")) == "", C.NAME_ERRORS["id"])


def name_matches(name: Column, wanted: Column) -> Column:
    """Whether a name holds what is searched for, whatever the case; a blank search matches all."""
    q = F.lower(trimmed(F.coalesce(wanted, F.lit(""))))
    return (q == "") | F.lower(name).contains(q)


def model_name(name: Column) -> Column:
    """A well-formed model name of at most 200 characters, else null."""
    return F.when(name.rlike(r"^\w[\w.:/-]{0,199}\z"), name)


def model_kind(name: Column) -> Column:
    return F.when(name.rlike("(?i)embed"), "embedding").otherwise("chat")


def base_url(url: Column) -> Column:
    """An http(s) address of this machine without its final slash; the default one for all others."""
    local = url.rlike(r"(?i)^https?://(?:[^/?#@]*@)?(?:localhost|127\.0\.0\.1)(?::\d{1,5})?(?:[/?#].*)?$")
    return F.when(local, F.regexp_replace(url, "/$", "")).otherwise("http://localhost:11434")


# --- labels ---------------------------------------------------------------


def status_class(status: Column) -> Column:
    return F.when(status == "ready", "ready").when(status == "error", "err").otherwise("proc")


def status_label(status: Column, error_label_: Column) -> Column:
    return F.when((status == "error") & (error_label_ != ""), error_label_).otherwise(mapped(status, C.STATUS_LABELS))


def step_label(step: Column) -> Column:
    return mapped(step, C.STEP_LABELS)


def error_label(step: Column, kind: Column) -> Column:
    return F.when((step == "parse") & (kind == "url"), C.PAGE_ERROR).otherwise(mapped(step, C.STEP_ERRORS))


def error_class(http_status: Column, aborted: Column) -> Column:
    """Class of a failed online call; without a status it was cut off or found no network."""
    return (
        F.when(http_status.isNull(), F.when(F.coalesce(aborted, F.lit(False)), "timeout").otherwise("network"))
        .when(http_status.isin(401, 403), "auth").when(http_status == 429, "rate-limit").when(http_status >= 500, "server").otherwise("unknown")
    )


def error_message(kind: Column, provider: Column) -> Column:
    message = mapped(kind, C.ONLINE_ERRORS)
    return F.when(F.coalesce(provider, F.lit("")) == "", message).otherwise(F.concat(provider, F.lit(": "), message))


def rollup_label(n: Column, pending: Column) -> Column:
    """Label of a notebook's sources."""
    noun = F.concat(n.cast("string"), F.lit(" nguồn · "))
    return F.when(n == 0, "").when(pending == 0, F.concat(noun, F.lit("đã lập chỉ mục"))).otherwise(F.concat(noun, F.lit("đang xử lý "), pending.cast("string")))


def kind_label(kind: Column, pages: Column) -> Column:
    pdf = F.concat(F.lit("PDF · "), pages.cast("string"), F.lit(" trang"))
    return F.when((kind == "pdf") & (pages > 0), pdf).otherwise(F.coalesce(mapped(kind, C.KIND_NAMES), mapped(kind, C.KIND_ICONS)))


def memory_tier(size: Column) -> Column:
    """struct<tier,gb> of a machine's memory in bytes: what size of model it can run."""
    gb = F.lit(1 << 30).cast("long")
    return F.struct(F.when(size < 8 * gb, "small").when(size <= 16 * gb, "medium").otherwise("large").alias("tier"), F.round(size / gb, 1).alias("gb"))


def runtime_status(reachable: Column, chat: Column, embedding: Column, installed: Column) -> Column:
    """struct<ready,reason> of a local runtime: the models chosen must be among those installed."""
    missing = F.array_except(F.array(chat, embedding), installed)
    unset = (F.coalesce(chat, F.lit("")) == "") | (F.coalesce(embedding, F.lit("")) == "")
    reason = F.when(~reachable, C.RUNTIME_REASONS["down"]).when(unset, C.RUNTIME_REASONS["unset"]).when(F.size(missing) > 0, F.concat(F.lit(C.RUNTIME_REASONS["missing"]), F.array_join(missing, ", "), F.lit(".")))
    return F.struct(reason.isNull().alias("ready"), reason.alias("reason"))


def reindex_phase(stored: Column) -> Column:
    return F.when(stored == C.MODEL_VERSION, "done").when(stored == C.MODEL_REINDEXING, "resume").otherwise("fresh")


def online_depth(steps: Column) -> Column:
    """Open uses after +1 and -1 steps in order; a close without an open one counts for nothing."""
    return F.aggregate(steps, F.lit(0), lambda s, x: F.greatest(s + x.cast("int"), F.lit(0)))


def clamped(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def parse_progress(done: Column) -> Column:
    """Progress of a source whose reader has done a share of its work."""
    return 0.1 + clamped(done, F.lit(0.0), F.lit(1.0)) * 0.15


def embed_progress(done: Column, total: Column) -> Column:
    """Share of a source's chunks that are embedded; a source without chunks is done."""
    return F.when(total > 0, done / total).otherwise(1.0)


def startup_error(product: str, kind: Column, stored: Column, known: Column) -> Column:
    """struct<title,detail,error_type> for users when a program can't start; the raw message is never shown.

    ``kind`` is the error's type; ``stored`` is the store's version where it is newer than
    ``known``, which the program supports, else null.
    """
    newer = stored.isNotNull()
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    # What users are told.
    title = F.when(newer, f"Cần cập nhật {product}").otherwise(f"{product} gặp lỗi khi khởi động")
    old = text(f"Dữ liệu trên máy được tạo bởi một phiên bản {product} mới hơn (schema v", stored.cast("string"), "), trong khi bản đang chạy chỉ hỗ trợ tới v", known.cast("string"), f".\n\nVui lòng cập nhật {product} lên phiên bản mới nhất rồi mở lại. Dữ liệu của bạn vẫn an toàn — ứng dụng cố ý không hạ cấp để tránh mất dữ liệu.")
    other = text("Ứng dụng không thể khởi động (loại lỗi: ", kind, ").\n\nVui lòng mở lại ứng dụng. Nếu vẫn lỗi, hãy cập nhật lên phiên bản mới nhất.")
    return F.struct(title.alias("title"), F.when(newer, old).otherwise(other).alias("detail"), kind.alias("error_type"))


def bytes_label(size: Column) -> Column:
    units = ("B", "KB", "MB", "GB", "TB", "PB")
    i = F.least(F.lit(len(units) - 1), F.floor(F.log(F.greatest(size, F.lit(1.0))) / F.log(F.lit(1024.0)))).cast("int")
    v = size / F.pow(F.lit(1024.0), i)
    number = F.when((i == 0) | (v >= 100), F.round(v).cast("long").cast("string")).otherwise(F.regexp_replace(F.format_string("%.1f", F.round(v, 1)), r"\.0$", ""))
    return F.when(size <= 0, "0 B").otherwise(F.concat(number, F.lit(" "), F.element_at(F.array(*map(F.lit, units)), i + 1)))


def relative_time(ms: Column, when: Column) -> Column:
    """Label of a moment ``when`` that lies ``ms`` milliseconds back."""
    part = lambda unit, word: F.concat(F.floor(ms / unit).cast("string"), F.lit(word))
    label = F.when(ms < 60_000, "vừa xong").when(ms < 3_600_000, part(60_000, " phút trước")).when(ms < 86_400_000, part(3_600_000, " giờ trước")).when(ms < 172_800_000, "hôm qua")
    return label.when(ms < 604_800_000, part(86_400_000, " ngày trước")).when(ms < 1_209_600_000, "tuần trước").otherwise(F.date_format(when, "dd/MM/yyyy"))
