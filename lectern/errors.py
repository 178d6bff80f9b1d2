"""Errors that callers tell apart by code."""

from __future__ import annotations


class EngineError(Exception):
    code = "internal_error"


def _kind(name: str, code: str) -> type[EngineError]:
    return type(name, (EngineError,), {"code": code, "__module__": __name__})


ConfigError = _kind("ConfigError", "config_error")
KbNotFound = _kind("KbNotFound", "kb_not_found")
KbExists = _kind("KbExists", "kb_exists")
DocNotFound = _kind("DocNotFound", "doc_not_found")
DocExists = _kind("DocExists", "doc_exists")
InvalidFilter = _kind("InvalidFilter", "invalid_filter")
ConfirmTokenInvalid = _kind("ConfirmTokenInvalid", "confirm_token_invalid")
JobNotFound = _kind("JobNotFound", "job_not_found")
ServiceUnavailable = _kind("ServiceUnavailable", "service_unavailable")
StageFailed = _kind("StageFailed", "pipeline_stage_failed")
