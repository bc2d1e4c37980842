"""An XML event is parsed once, and listed children of System yield nothing for the others."""

from __future__ import annotations

from test_single_pass import plan_of

from logloom.sources import windows_xml

_TEXT = """junk<Event xmlns="x"><System><Level>4</Level><Odd Kind="a&amp;b" b='c'>t&lt;x</Odd><odd/><ns:Foo a="1"/><LEVEL>9</LEVEL>
<Levels>7</Levels><Execution><Foo>in</Foo></Execution></System><EventData><Data Name="A">1</Data><Data>2</Data></EventData></Event>
<Event><System><Level>4</System></Event><Events>x</Events>"""


def test_an_event_is_parsed_once(spark, tmp_path):
    (tmp_path / "a.xml").write_text(_TEXT)
    events, broken = windows_xml.read_xml_events(spark, str(tmp_path))
    assert plan_of(events).count("from_xml(") == 1
    assert [r.fields for r in events.select("fields").collect()] == [{
        "level": "9", "odd": "t<x", "odd_kind": "a&b", "odd_b": "c", "foo_a": "1", "levels": "7", "foo": "in", "a": "1", "data_9": "2"}]
    assert [r.line for r in broken.select("line").collect()] == ["<Event><System><Level>4</System></Event>"]
