"""What a request can come to besides an answer: errors with the status and the body that a caller sees."""

from __future__ import annotations

from pyspark.sql import Row


class ApiError(Exception):
    """An error of the service. body() has its kind and its fields."""

    status = 500

    def __init__(self, message: str = "", **fields) -> None:
        super().__init__(message or type(self).__name__)
        self.fields = fields

    def body(self) -> dict:
        return {"error": type(self).__name__, "message": str(self), **self.fields}


class NotFound(ApiError, LookupError):
    """A login, repository or vector that the tables do not have."""

    status = 404


class BadRequest(ApiError, ValueError):
    status = 400


class SyncInProgress(ApiError):
    """A run of this login is under way."""

    status = 409


class SyncCooldown(ApiError):
    """This login was synced too short a time ago; retry_after says how many seconds are left."""

    status = 429


class BudgetExceeded(ApiError):
    """The day's budget of a scope is used up."""

    status = 429


class IndexNotReady(ApiError):
    """The index of this login is still being built; phase says how far it is."""

    status = 503


class Upstream(ApiError):
    """The host that is crawled failed, or asks to wait (retry_after, where it said so)."""

    status = 502


def response(error: BaseException) -> tuple[int, dict]:
    """Status and body of any error; what is none of the service's says nothing of itself."""
    return (error.status, error.body()) if isinstance(error, ApiError) else (500, {"error": "InternalError", "message": "InternalError"})


def admitted(login: str, answer: Row) -> None:
    """Nothing if a sync may start by planning.admission's answer (allowed, reason, wait_s), else the error that says why not."""
    if answer.allowed:
        return
    if answer.reason == "in-progress":
        raise SyncInProgress(f"a sync of {login} is running", login=login)
    raise SyncCooldown(f"{login} was synced a short time ago", login=login, reason=answer.reason, retry_after=answer.wait_s)


def within_budget(scope: str, answer: Row) -> None:
    """Nothing if a row of planning.daily_budget (used, allowed) is within its budget."""
    if not answer.allowed:
        raise BudgetExceeded(f"the budget of {scope} is used up", scope=scope, used=answer.used)


def of_page(row: Row) -> None:
    """Nothing for a recorded page that can be used, else the error that a sync ends with."""
    if row.state == "missing":
        raise NotFound(row.error or "not found", page=row.page)
    if row.state not in ("ok", "unchanged"):
        raise Upstream(row.error or row.state, page=row.page, state=row.state, retry_after=row.wait_s)
