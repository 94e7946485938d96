"""Column-expression functions: everything here returns a ``Column`` built
from ``pyspark.sql.functions`` so it stays inside whole-stage codegen."""

from .clock import (as_wall_clock, calendar_columns, day_name, epoch_ms, minute_text,
                    parse_log_time, range_text, utc_text)
from .codes import (event_code, event_log_level, failed_flag, firewall_event_type,
                    is_privileged_user, log_level_code, log_type_code, lookup,
                    protocol_code, security_event_type)
from .ip import ipv4_to_long, is_external_ip, is_external_ip_strict
from .text import (as_text, collapse_ws, int_map_value, na_to_null, py_strip, to_number,
                   usable_map_value)

__all__ = [n for n in dir() if not n.startswith("_")]
