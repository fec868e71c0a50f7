from datetime import UTC, datetime, timedelta, timezone

import pytest

from rowtide.functions.moments import describe_window, duration, filter_from, parse_time, plural, split_list, whole_number
from rowtide.functions.predicates import BadRequest, Filter, Refused
from rowtide.sources.server import ConnectionString, check_settings, flavor_of, identity, preflight, redact, statement_capture

GOOD = {"binlog_format": "row", "binlog_row_image": "FULL", "binlog_row_metadata": "full", "server_uuid": "u", "gtid_mode": "ON"}


def test_settings():
    check_settings(GOOD)
    for change in ({"binlog_format": "MIXED"}, {"binlog_row_image": "MINIMAL"}, {"binlog_row_value_options": "partial_json"}):
        with pytest.raises(Refused):
            check_settings(GOOD | change)
    for name in ("binlog_format", "binlog_row_image", "binlog_row_metadata"):
        with pytest.raises(Refused, match=name):
            check_settings({k: v for k, v in GOOD.items() if k != name})


def test_identity():
    assert flavor_of("10.11.6-MariaDB") == "mariadb" and flavor_of("8.0.36") == "mysql"
    assert identity("mysql", GOOD) == ("mysql:u", "mysql")
    assert identity("mysql", GOOD | {"gtid_mode": "OFF_PERMISSIVE"}) == ("mysql:u", "")
    assert identity("mariadb", {"gtid_domain_id": "0", "server_id": "3"}) == ("mariadb:0:3", "mariadb")
    for flavor in ("mysql", "mariadb"):
        with pytest.raises(Refused):
            identity(flavor, {})
    assert statement_capture("mariadb", {"binlog_annotate_row_events": "on"}) and not statement_capture("mysql", {"binlog_annotate_row_events": "ON"})
    assert preflight("8.0", GOOD).binding.server_identity == "mysql:u"


def test_connection_strings():
    c = ConnectionString.parse("ada:p@ss:w@tcp(db.example)/shop")
    assert (c.user, c.password, c.address) == ("ada", "p@ss:w", "db.example:3306") and "p@ss" not in repr(c)
    assert ConnectionString.parse("u:p@h:1").address == "h:1"
    for bad in ("", "nohost", ":p@h", "u:p@", "u:p@tcp)h(", "u:secret@/db"):
        with pytest.raises(Refused) as e:
            ConnectionString.parse(bad)
        assert "secret" not in str(e.value)
    assert redact("u:secret@h:1") == "u:***@h:1" and redact("nothing") == "nothing" and redact("u@h") == "u@h"


def test_times():
    now, east = datetime(2026, 7, 25, 0, 10, tzinfo=timezone(timedelta(hours=2))), timezone(timedelta(hours=2))
    at = lambda s: parse_time(s, now, east)
    assert at("2026-07-25T17:20:00Z") == datetime(2026, 7, 25, 17, 20, tzinfo=UTC)
    assert at("2026-07-25T17:20:00+0200") == at("2026-07-25 17:20:00") == at("2026-07-25T17:20") == datetime(2026, 7, 25, 15, 20, tzinfo=UTC)
    assert at("2027-01-01") == datetime(2026, 12, 31, 22, tzinfo=UTC)
    assert at("23:50") == datetime(2026, 7, 24, 21, 50, tzinfo=UTC)
    assert at("00:10") == datetime(2026, 7, 24, 22, 10, tzinfo=UTC)
    for bad in ("", "now", "25:00", "2026-13-01", "17:20 "):
        with pytest.raises(BadRequest):
            at(bad)


def test_parameters():
    assert split_list(" a, ,b ") == ("a", "b") and whole_number("", "x") == 0 and whole_number("-5", "x") == -5
    for bad in ("lots", "1.5", "9" * 30):
        with pytest.raises(BadRequest):
            whole_number(bad, "limit")
    with pytest.raises(BadRequest, match="from"):
        filter_from({"from": "x"})
    t = datetime(2024, 1, 1, tzinfo=UTC)
    assert [describe_window(f) for f in (Filter(), Filter((), t), Filter((), None, t), Filter((), t, t))] == ["", "from 2024-01-01 00:00:00 UTC", "up to 2024-01-01 00:00:00 UTC", "2024-01-01 00:00:00 UTC to 2024-01-01 00:00:00 UTC"]
    assert plural(1, "gap") == "1 gap" and plural(0, "gap") == "0 gaps" and duration(3605) == "1h0m5s" and duration(59.6) == "1m0s"
