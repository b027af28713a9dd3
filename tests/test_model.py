import pytest

from tessera.errors import SchemaError
from tessera.functions import parse_datetime, seconds_of
from tessera.model import Family, Group, Schema, check_row

GOOD = """<Schema>
<AccessGroup name="archive"><ColumnFamily><Name>scan</Name></ColumnFamily></AccessGroup>
<AccessGroup name="index" inMemory="true">
<ColumnFamily><Name>title</Name><MaxVersions>7</MaxVersions><ttl>900</ttl></ColumnFamily>
<ColumnFamily><Name>shelf</Name><ttl>86400</ttl></ColumnFamily>
<ColumnFamily><Name>loans</Name><MaxVersions>2</MaxVersions></ColumnFamily>
</AccessGroup></Schema>"""


def test_good_schema():
    s = Schema.from_xml(GOOD)
    assert [(f.name, f.id, f.max_versions, f.ttl) for f in s.families] == [("scan", 1, 0, 0), ("title", 2, 7, 900), ("shelf", 3, 0, 86400), ("loans", 4, 2, 0)]
    assert s.groups[1].in_memory and s.group_of("loans") == "index" and Schema.from_json(s.to_json()) == s
    assert Schema.from_xml(s.to_xml()) == s == Schema.from_xml(s.to_xml(True))


@pytest.mark.parametrize(
    "change",
    [
        ("</AccessGroup></Schema>", "</Schema>"),  # not closed
        ("<Name>scan</Name>", "<Name>scan</Name><ColumnFamily/>"),  # a family in a family
        ('<AccessGroup name="archive">', "<AccessGroup>"),  # no name
        ('inMemory="true"', 'fast="true"'),  # an attribute that there isn't
        ('inMemory="true"', 'inMemory="2"'),
        ("<MaxVersions>7</MaxVersions>", "<Revisions>7</Revisions>"),  # an element that there isn't
        ("<MaxVersions>7<", "<MaxVersions>seven<"),
        ("<MaxVersions>2<", "<MaxVersions>-2<"),
        ("<ttl>900<", "<ttl>later<"),
        ('name="index"', 'name="archive"'),  # two groups of a name
        ("<Name>loans<", "<Name>shelf<"),  # two families of a name
    ],
)
def test_bad_schemas(change):
    assert change[0] in GOOD
    with pytest.raises(SchemaError):
        Schema.from_xml(GOOD.replace(*change))


def test_bad_options():
    for group in (Group("g", compressor="rar"), Group("g", bloom="maybe")):
        with pytest.raises(SchemaError):
            Schema.define([Family("a")], [group])
    with pytest.raises(SchemaError):
        Schema.define([Family("a")], [Group("g", ("a",)), Group("h", ("a",))])
    with pytest.raises(SchemaError):
        Schema.define([Family(f"n{k}") for k in range(256)])


def test_literals():
    assert parse_datetime("1970-01-02") == 86_400 * 10**9 and parse_datetime("1970-01-01 00:00:01.5") == 10**9 + 5
    assert seconds_of(1.5, "DAYS") == 129_600 and seconds_of(2, "month") == 5_184_000 and seconds_of(1.9) == 1
    for row in ("", None, "a\0b"):
        with pytest.raises(Exception):
            check_row(row)
