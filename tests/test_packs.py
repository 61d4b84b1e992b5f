import pytest
import yaml
from conftest import rule
from pyspark.sql import functions as F

from earshot.sources import packs as source


def files(spark, **named):
    rows = [(f"/p/{name}.yml", body if isinstance(body, bytes) else yaml.safe_dump(body, allow_unicode=True).encode())
            for name, body in named.items()]
    return spark.createDataFrame(rows, "source_path string, content binary")


def pack(*rules, language="en", **extra):
    return {"version": 1, "language": language, "rules": list(rules), **extra}


def test_order_and_tables(spark):
    got = source.packs_from_files(files(
        spark, b=pack(rule("en.x", "exact", "Hello  WORLD!", "ＡＢＣ", review=True)), a=pack(rule("de.x", "fuzzy", "Straßen"), language="de"),
    ))
    assert got.languages == ("de", "en")
    rows = {(r.language, r.pattern_ord): r for r in got.patterns.collect()}
    assert rows["en", 0].pattern == "hello world" and rows["en", 0].n_tokens == 2 and rows["en", 0].run_chars is None
    assert rows["en", 1].pattern == "abc" and rows["en", 1].source_pattern == "ＡＢＣ"
    assert rows["de", 0].pattern == "strassen" and rows["de", 0].run_lens == [1, 1, 1, 1, 2, 1, 1][:2] + [1, 1, 2, 1, 1]
    assert [r.context_required for r in got.rules.orderBy("pack_ord").collect()] == [False, True]


BROKEN = [
    ({"id": "Bad"}, "invalid_rule_id"), ({"id": 3}, "invalid_rule_id"), ({"category": "rude"}, "invalid_category"),
    ({"category": ["spam"]}, "invalid_category"), ({"severity": True}, "invalid_severity"), ({"severity": 4}, "invalid_severity"),
    ({"severity": "1"}, "invalid_severity"), ({"match": "prefix"}, "invalid_match_type"), ({"term": ""}, "invalid_term"),
    ({"term": "x" * 257}, "invalid_term"), ({"term": "!!"}, "invalid_term"), ({"variants": "x"}, "invalid_variants"),
    ({"variants": [""]}, "invalid_variants"), ({"variants": ["x"] * 65}, "invalid_variants"),
    ({"context_required": 1}, "invalid_context_required"), ({"match": "fuzzy", "term": "two words"}, "fuzzy_pattern_not_single_token:two words"),
    ({"match": "fuzzy", "term": "abc"}, "fuzzy_pattern_too_short:abc"), ({"match": "regex", "term": "("}, "invalid_regex"),
    ({"match": "regex", "term": "a*"}, "empty_regex"), ({"match": "regex", "term": "a"}, "regex_rule_needs_probe"),
    ({"match": "regex", "term": "a", "probe": "?!"}, "regex_probe_normalises_to_nothing"),
    ({"match": "regex", "term": "a-b", "probe": "A-b"}, "regex_probe_does_not_match:a b"),
]


def test_every_rule_fault_has_its_code(spark):
    base = rule("en.x", "exact", "word")
    named = {f"f{i:02d}": pack({**base, **change}) for i, (change, _) in enumerate(BROKEN)}
    parsed = source.parse_packs(files(spark, **named)).filter("entry = 'fault'").orderBy("source_path").collect()
    got = [r.code if r.detail is None else f"{r.code}:{r.detail}" for r in parsed]
    assert got == [code for _, code in BROKEN]


def test_document_faults(spark):
    word = rule("en.x", "exact", "word")
    named = {
        "a": b"a: [", "b": b"[1]", "c": {"version": 2}, "d": pack(word, language="EN"), "e": pack(),
        "f": pack(*[{**word, "id": f"r{i}"} for i in range(1001)]), "g": pack(word, word), "h": pack("x"),
        "i": pack(word, allow="x"), "j": pack(word, allow=["!!"]), "k": pack(word, allow=["WORD"]),
        "l": pack(word, allow=["w"] * 513), "m": b"\xff\xfe",
    }
    rows = source.parse_packs(files(spark, **named)).filter("entry = 'fault'").orderBy("source_path").collect()
    assert [r.code for r in rows] == [
        "invalid_yaml", "invalid_pack", "invalid_pack", "invalid_language", "invalid_rules", "invalid_rules",
        "duplicate_rule_id", "invalid_rule", "invalid_allow", "invalid_allow", "allow_shadows_rule", "invalid_allow",
        "invalid_yaml",
    ]
    assert rows[10].detail == "word"


def test_modes(spark):
    mixed = files(spark, a=pack({**rule("en.x", "exact", "w"), "severity": 9}), b=pack(rule("de.x", "exact", "w"), language="de"))
    with pytest.raises(source.PackFault, match="invalid_severity"):
        source.packs_from_files(mixed)
    reported = source.packs_from_files(mixed, "report")
    assert reported.languages == ("de",) and [r.code for r in reported.rejects.collect()] == ["invalid_severity"]
    with pytest.raises(ValueError, match="duplicate rule language: en"):
        source.packs_from_files(files(spark, a=pack(rule("en.x", "exact", "w")), b=pack(rule("en.y", "exact", "v"))))
    with pytest.raises(ValueError, match="no rule packs"):
        source.packs_from_files(files(spark, a=b"x"), "report")


def test_directory_reads_only_yml(spark, tmp_path):
    (tmp_path / "en.yml").write_bytes(yaml.safe_dump(pack(rule("en.x", "exact", "w"))).encode())
    (tmp_path / "notes.txt").write_text("no pack")
    assert source.read_packs(spark, str(tmp_path)).languages == ("en",)


@pytest.mark.parametrize("pattern, loose", [
    (r"\bth(?:tion|ing)\b", "th(?:tion|ing)"), ("Abc d+", "abc d+"), (r"\w+", None), ("straße", None), ("a*", None),
    ("[ab]c", None), ("(", None), ("x(a|)", "x(a|)"),
])
def test_prefilter_only_where_it_is_safe(pattern, loose):
    assert source.jvm_prefilter(pattern) == loose


def test_regex_rules_on_odd_letters(spark, make_packs):
    """The rule engine takes dotless i for i; the prefilter must let it through."""
    from test_match import found
    import model

    rules = [rule("en.r", "regex", "thing", probe="thing"), rule("en.s", "regex", "straße", probe="strasse")]
    packs = make_packs({"en": (rules, [])})
    texts = ["a thıng", "STRASSE", "THING", "th1ng"]
    got = found(spark, packs, texts, ["en"])
    assert [got[i] for i in range(4)] == [model.matches(t, rules) for t in texts]
    assert F is not None


def test_parsed_rows_leave_before_they_are_many(monkeypatch):
    import pyarrow as pa

    from earshot.sources import packs as source

    monkeypatch.setattr(source, "PARSED_ROWS", 10)
    pack = yaml.safe_dump({"version": 1, "language": "en", "rules": [rule(f"en.r{i}", "exact", f"word{i}") for i in range(3)]}).encode()
    files = pa.RecordBatch.from_pydict({"source_path": [f"/p/{i}.yml" for i in range(20)], "content": [pack] * 20})
    parts = list(source._parse_batches(iter([files])))
    assert sum(p.num_rows for p in parts) == 20 * 6 and max(p.num_rows for p in parts) <= 10 + 6
    assert len({x for p in parts for x in p["source_path"].to_pylist()}) == 20
