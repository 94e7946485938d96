"""Fixed category codes and lookups.

Lookups are ``create_map`` literals: constant-folded by Catalyst, evaluated
inside whole-stage codegen, no join and nothing to broadcast.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from .. import constants as C


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def lookup(col, mapping: dict, default=None) -> Column:
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    out = m[_c(col)]
    return out if default is None else F.coalesce(out, F.lit(default))


def event_code(col) -> Column:
    return lookup(col, C.EVENT_CODES, C.EVENT_CODE_DEFAULT).cast("int")


def log_level_code(col) -> Column:
    return lookup(col, C.LOG_LEVEL_CODES, C.LOG_LEVEL_CODE_DEFAULT).cast("int")


def protocol_code(col) -> Column:
    return lookup(col, C.PROTOCOL_CODES, C.PROTOCOL_CODE_DEFAULT).cast("int")


def log_type_code(col) -> Column:
    return lookup(col, C.LOG_TYPE_CODES, C.LOG_TYPE_CODE_DEFAULT).cast("int")


def is_privileged_user(col) -> Column:
    """exact, case-sensitive match."""
    return F.when(_c(col).isin(C.PRIVILEGED_USERS), 1).otherwise(0)


def security_event_type(event_id) -> Column:
    """F10 (security log): 4624 -> LOGIN_SUCCESS, anything else -> LOGIN_FAILED."""
    return F.when(_c(event_id) == C.LOGON_SUCCESS_ID, "LOGIN_SUCCESS").otherwise("LOGIN_FAILED")


def firewall_event_type(event_id) -> Column:
    return lookup(event_id, C.FIREWALL_EVENT_TYPES, C.FIREWALL_EVENT_DEFAULT)


def event_log_level(event_id, default: str = "INFORMATION") -> Column:
    """F11."""
    return F.when(_c(event_id).isin(C.WARNING_EVENT_IDS), "WARNING").otherwise(default)


def failed_flag(event_type) -> Column:
    """F12."""
    return F.when(_c(event_type) == "LOGIN_FAILED", 1).otherwise(0)
