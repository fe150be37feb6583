"""Failures that callers can tell apart."""

import re


class UserNotFound(Exception):
    """The list service has no such user."""


class RateLimitExceeded(Exception):
    """The service refuses further requests for now."""


class InvalidToken(Exception):
    """The service refuses the token."""


class ItemNotFound(Exception):
    """The catalogue has no item of this id."""


#: HTTP statuses with a meaning of their own.
STATUS_ERRORS = {401: InvalidToken, 404: UserNotFound, 429: RateLimitExceeded}


def failure_in(message: str) -> type[Exception] | None:
    """What the status in a message of check_status()'s stands for, wherever it was raised; None if it names none."""
    found = re.search(r"service status (\d{3})\b", message)
    return STATUS_ERRORS.get(int(found[1])) if found else None


def check_status(status: int, what: str) -> None:
    """Raise what an HTTP status stands for; 200 passes, and a status without a meaning here is NotImplementedError."""
    if status == 200:
        return
    if status in STATUS_ERRORS:
        raise STATUS_ERRORS[status](f"{what}: service status {status}")
    raise NotImplementedError(f"{what}: unexpected service status {status}")
