"""Outcome of a fetch attempt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlframe import rules
from crawlframe.functions import urls as U


def classify_fetch(
    url: Column, status_code: Column, error_type: Column, content_type: Column,
    n_chars: Column, relevant: Column, detail: Column | None = None,
    is_text: Column | None = None, strict: bool = False, timeout: int = 30,
) -> Column:
    """struct(status, error_message) of one attempt; the first failing gate speaks.

    `strict` is the collector's reading: only text/html counts as a page, and a
    page of another type is left out silently (status `ignored`).
    """
    detail = F.coalesce(detail if detail is not None else F.lit(""), F.lit(""))
    is_text = is_text if is_text is not None else F.lit(True)
    html = U.is_html(content_type, url, strict)
    request_error, unknown_error = (
        ("Request Exception: ", "Unknown Error: ") if strict
        else (rules.MSG_REQUEST, rules.MSG_UNKNOWN)
    )
    not_html = (
        F.lit(None).cast("string") if strict
        else F.concat(F.lit(rules.MSG_NOT_HTML), F.lower(F.coalesce(content_type, F.lit(""))))
    )
    failed = error_type.isNotNull() | (status_code != 200)
    message = (
        F.when(error_type == "timeout",
               F.concat(F.lit(request_error), detail) if strict
               else F.lit(rules.MSG_TIMEOUT.format(timeout)))
        .when(error_type == "request", F.concat(F.lit(request_error), detail))
        .when(error_type.isNotNull(), F.concat(F.lit(unknown_error), detail))
        .when(status_code != 200, F.concat(F.lit("HTTP "), status_code.cast("string")))
        .when(~html, not_html)
        .when(~is_text, rules.MSG_NOT_TEXT)
        .when((n_chars < 10) if not strict else F.lit(False), rules.MSG_TOO_SHORT)
        .when(~relevant, rules.MSG_OFF_TOPIC)
    )
    ignored = ~failed & ~html if strict else F.lit(False)
    status = F.when(ignored, "ignored").when(message.isNull(), "success").otherwise("failed")
    return F.struct(status.alias("status"), message.alias("error_message"))


def retry_plan(status_code: Column, error_type: Column, retries: Column, max_retries: int = 3) -> Column:
    """struct(action, retry_times): retry failed attempts until the limit."""
    failed = error_type.isNotNull() | (status_code >= 400)
    action = F.when(~F.coalesce(failed, F.lit(False)), "done").when(
        retries < max_retries, "retry"
    ).otherwise("give_up")
    return F.struct(
        action.alias("action"),
        F.when(action == "retry", retries + 1).otherwise(retries).alias("retry_times"),
    )
