"""The JSON lattice, the scanner and the NDJSON operators."""

import io
import json

import pytest
from pyspark.sql import functions as F

from lexmill.cli import main
from lexmill.sources import jsontype as J
from lexmill.sources import ndjson

VALID = {
    "null": "null", " null ": "null", "": "null", "  ": "null", "true": "boolean", "31337": "integer", "+1": "integer", "01": "integer", "-1": "integer",
    "0.1": "real", "1e17": "real", "5.0e+006": "real", "1.": "real", "-.1": "real", "-Infinity": "real", "NaN": "real", '"hello"': "text", "[]": "[null; 0]",
    "[1, 2, 3]": "[integer; 3]", "[[1], [2], [3]]": "[[integer; 1]; 3]", "[1,false,3]": "[any; 3]", "[1,null,2.2]": "[real; 3]", "{}": "{}",
    '{"outer_a": true, "outer_b": {"re": 0.0, "im": null}}': '{ "outer_a": boolean, "outer_b": { "im": null, "re": real } }',
}
INVALID = ["n", "nulll", "null null", "tru", "true1", "false (really)", "1a", "-", "1e", "1E+", "[1a]", "hello", '"hello" world', '"\\a"', '"\\', '"\\u007"', '"\\u0G7F"', '"\\uD800"', '"\\uD800\\uDC0G"', '"\\uDC00"', "[null, ]", '{"a":}', '{"a":1,}', '{"x":,"y":null}', '{"a":1,"a":2}', '{"\\u00e8": 3, "e\\u0300": 4}', "."]


@pytest.mark.parametrize("line", VALID)
def test_valid(line):
    t = J.scan(line)[0]
    assert t.render() == VALID[line] and J.parse(t.render()) == t


@pytest.mark.parametrize("line", INVALID)
def test_invalid(line):
    with pytest.raises(ValueError):
        J.scan(line)


def test_union():
    p = J.parse
    cases = [("null", "integer", "integer"), ("[real; 5]", "null", "[real; 5]"), ("null", "any", "any"), ("text", "real", "any"), ("[integer; 5]", "text", "any"), ("integer", "real", "real"), ("[integer; 5]", "[real; 5]", "[real; 5]"), ("[text; 0]", "[text; 3]", "[text]"), ("[[boolean; 2]; 5]", "[[null; 0]; 4]", "[[boolean]]"), ("{}", '{"a": integer}', '{"a": integer}'), ('{"a": text, "b": null}', '{"b": integer, "c": boolean}', '{"a": text, "b": integer, "c": boolean}')]
    for a, b, want in cases:
        assert p(a) | p(b) == p(b) | p(a) == p(want)


def test_decode():
    assert [J.decode_int(x) for x in ("-0", "123456789", "9223372036854775807", "+99999999999999999999999", "-99999999999")] == [0, 123456789, J.INT_MAX, J.INT_MAX, J.INT_MIN]
    assert J.decode_double("1e99999999999") == float("inf") and J.decode_double("0E4933") == 0 and J.decode_double("314E-2") == 3.14
    assert J.decode_bool("true") and J.decode_bool("null") is None and J.decode_text('"\\ud83d\\ude00\\n"') == "😀\n"


def test_lines(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b'{"text": "One. Two.", "b": {"c":  1 }}\n"bare\\ttext"\n{"a": 1.5}\nnull')
    lines = ndjson.read_lines(spark, str(tmp_path / "a.json"))
    assert lines.count() == 4
    got = [tuple(r) for r in lines.select(ndjson.get_field(F.col("value"), "b"), ndjson.text_of(F.col("value")), ndjson.n_fields(F.col("value"))).collect()]
    assert got == [('{"c":  1 }', "One. Two.", 2), (None, "bare\ttext", None), (None, None, 1), (None, None, None)]
    t, n = ndjson.scan_schema(lines)
    assert (t.render(), n) == ("any", 4)
    broken = spark.createDataFrame([("{",), ("1",)], "value string")
    assert {r.type: r.n for r in ndjson.scan_types(broken, mode="PERMISSIVE").collect()} == {None: 1, "integer": 1}
    with pytest.raises(Exception, match="invalid JSON"):
        ndjson.scan_types(broken).collect()


def test_commands(spark, tmp_path):
    path = str(tmp_path / "b.json")
    with open(path, "w") as f:
        f.write("".join(json.dumps({"text": t}) + "\n" for t in ("A rose is a rose.", "Mr. Red! No?")) + "1\n")

    def said(*args):
        out = io.StringIO()
        assert main(list(args), spark, out) == 0
        return out.getvalue().splitlines()

    assert said("get", path, "text") == ['"A rose is a rose."', '"Mr. Red! No?"', "null"]
    assert said("scan", path) == ["any", "3 rows"]
    assert said("sentences", path)[1:] == ['["Mr. ", "Red! ", "No?"]', "null"]
    assert said("tokens", path, "-d", "punct", "-t", "english")[0] == '["rose", "rose"]'
    assert said("ngrams", path, "-n", "2", "-d", "punct") == ["Found 11 2-grams."]


def test_output_escapes(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"text": "Caf\\u00e9 \\"x\\". Oui\\n\\ud83d\\ude00!"}\n"Z\u00fcge"\n', "utf-8")
    out = io.StringIO()
    main(["sentences", str(path)], spark, out)
    assert out.getvalue().splitlines() == ['["Caf\\u00e9 \\"x\\". ", "Oui\\n\\ud83d\\ude00!"]', '["Z\u00fcge"]']
    out = io.StringIO()
    main(["tokens", str(path), "-d", "punct"], spark, out)
    assert out.getvalue().splitlines() == ['["caf\\u00e9", "x", "oui", "\\ud83d\\ude00"]', '["z\\u00fcge"]']


def test_arrays(spark):
    lines = ['[1, "a, ]", [2, [3]], {"k": [4]}, null]', " [ ] ", '{"a": [1]}', "3", "", "[1,2"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    c = F.col("value")
    got = [(r[0], r[1]) for r in df.select(ndjson.items_of(c, "PERMISSIVE"), ndjson.n_items(c, "PERMISSIVE")).collect()]
    assert got == [(["1", '"a, ]"', "[2, [3]]", '{"k": [4]}', "null"], 5), ([], 0), (None, None), (None, None), (None, None), (None, None)]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in ("true", " false ", "null", "1", '"true"')], "value string").select(ndjson.as_bool(c)).collect()] == [True, False, None, None, None]


def test_deep_nesting(spark):
    """Depth is no error in itself; types too deep to be merged count as invalid lines."""
    assert J.scan("[" * 600 + "]" * 600)[0].render().startswith("[[[")
    assert len(J.scan('{"a":' * 400 + "1" + "}" * 400)[1]) == 1
    with pytest.raises(ValueError):
        J.scan("[" * 600)
    df = spark.createDataFrame([("[" * 20_000 + "]" * 20_000,), ("1",)], "value string")
    assert ("integer", 1) in [(r.type, r.n) for r in ndjson.scan_types(df, mode="PERMISSIVE").collect()]
