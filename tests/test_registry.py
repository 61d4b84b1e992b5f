import hashlib
import json

import pytest

from earshot import schemas
from earshot.sources import registry

ENTRY = """[[languages]]
code = "{code}"
name = "{name}"
cloud_base = {base}
cloud_selectable = {sel}
models = {models}
rule_pack = "{pack}"
evidence = "{evidence}"
"""


def catalog(*entries):
    base = dict(code="en", name="English", base="true", sel="true", models='["m"]', pack="verified", evidence="pilot")
    return "schema = 1\n" + "".join(ENTRY.format(**{**base, **e}) for e in entries)


def read(spark, tmp_path, text):
    path = tmp_path / "c.toml"
    path.write_text(text)
    return registry.read_language_catalog(spark, str(path))


def test_catalog_reads(spark, tmp_path):
    got = read(spark, tmp_path, catalog({}, dict(code="fi", name="Finnish", base="false", sel="false", pack="none")))
    assert {r.code for r in registry.moderation_codes(got).collect()} == {"en"}
    assert {r.code for r in registry.selectable_codes(got).collect()} == {"en"}
    assert [r.code for r in registry.base_code(got).collect()] == ["en"]


@pytest.mark.parametrize("entries, fault", [
    ([{}, {}], "duplicate code"), ([{}, dict(code="auto", base="false", sel="false")], "auto is not a language"),
    ([dict(base="false")], "exactly one base"), ([dict(sel="false")], "base language must be selectable"),
    ([{}, dict(code="de", base="false", pack="draft")], "verified pack"), ([dict(models="[]")], "models must be listed"),
    ([dict(models='["m", "m"]')], "models must be unique"), ([dict(name=" ")], "empty name"),
    ([dict(pack="x", sel="false", base="false")], "invalid rule_pack"), ([dict(evidence="x")], "invalid evidence"),
    ([dict(code="de")], "base language must be en"),
])
def test_catalog_faults(spark, tmp_path, entries, fault):
    with pytest.raises(ValueError, match=fault):
        read(spark, tmp_path, catalog(*entries))


def test_catalog_keys_and_schema(spark, tmp_path):
    with pytest.raises(ValueError, match="known schema"):
        read(spark, tmp_path, catalog({}).replace("schema = 1", "schema = 2"))
    with pytest.raises(ValueError, match="entry keys"):
        read(spark, tmp_path, catalog({}) + 'extra = "x"\n')


def test_model_registry(spark, tmp_path):
    model = '[[models]]\nid = "{}"\nfamily = "f"\nlanguages = ["en", "de"]\nlicense_name = "x"\n'
    path = tmp_path / "m.toml"
    path.write_text("schema = 2\n" + model.format("a") + model.format("b"))
    rows = registry.read_model_registry(spark, str(path)).collect()
    assert [(r.model_id, r.languages) for r in rows] == [("a", ["en", "de"]), ("b", ["en", "de"])]
    path.write_text("schema = 2\n" + model.format("a") + model.format("a"))
    with pytest.raises(ValueError, match="duplicate model id"):
        registry.read_model_registry(spark, str(path))


def parse(spark, *texts):
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "source_path string, value string")
    good, bad = registry.parse_credentials(files)
    return {r.server_id: r for r in good.collect()}, {(r.source_path, r.server_id): r.code for r in bad.collect()}


def test_credentials(spark):
    good, bad = parse(spark, json.dumps({
        "plain": "tok", "full": {"token": "tok2", "plan": "pro", "languages": ["en", "de", "en"],
                                 "rate-limit-per-minute": 30, "expires": "2026-01-01T00:00:00"},
        "zoned": {"token": "tok3", "expires": "2026-01-01T02:00:00+02:00", "languages": None},
        "braces": "{not json}",
    }))
    assert bad == {}
    assert bytes(good["plain"].token_digest) == hashlib.sha256(b"tok").digest()
    assert good["full"].languages == ["de", "en"] and good["full"].rate_limit_per_minute == 30
    assert good["full"].expires_at == good["zoned"].expires_at and good["zoned"].languages is None
    assert good["plain"].plan == "selfhost" and good["full"].plan == "pro"


@pytest.mark.parametrize("entry, code", [
    ("", "invalid_token"), ([1], "invalid_entry"), (5, "invalid_entry"), ({"token": "t", "x": 1}, "unknown_keys"), ({"plan": "p"}, "invalid_token"),
    ({"token": 5}, "invalid_token"), ({"token": "t", "plan": "Pro"}, "invalid_plan"), ({"token": "t", "plan": None}, "invalid_plan"),
    ({"token": "t", "languages": []}, "invalid_languages"), ({"token": "t", "languages": ["pt-BR"]}, "invalid_languages"),
    ({"token": "t", "languages": "en"}, "invalid_languages"), ({"token": "t", "languages": [1]}, "invalid_languages"),
    ({"token": "t", "rate-limit-per-minute": 0}, "invalid_rate_limit"), ({"token": "t", "rate-limit-per-minute": True}, "invalid_rate_limit"),
    ({"token": "t", "rate-limit-per-minute": "5"}, "invalid_rate_limit"), ({"token": "t", "expires": "soon"}, "invalid_expiry"),
    ({"token": "t", "expires": 5}, "invalid_expiry"),
])
def test_credential_faults(spark, entry, code):
    assert parse(spark, json.dumps({"s": entry})) == ({}, {("0", "s"): code})


def test_tokens_file(spark, tmp_path):
    path = tmp_path / "tokens.json"
    path.write_text(json.dumps({"s": {"token": "t", "languages": ["en"]}}, indent=2))
    read = registry.read_credentials(spark, str(path))
    assert [f.name for f in read.schema] == schemas.CREDENTIALS.fieldNames()
    assert [f.dataType for f in read.schema] == [f.dataType for f in schemas.CREDENTIALS]
    assert read.first().server_id == "s" and read.first().tenant_key is None
    path.write_text(json.dumps({"s": {"token": ""}}))
    with pytest.raises(ValueError, match="invalid_token"):
        registry.read_credentials(spark, str(path))


def test_credential_file_faults(spark):
    assert parse(spark, "[]", "{", "{}")[1] == {(str(i), None): "invalid_file" for i in range(3)}
    assert parse(spark, json.dumps({"a": "t", "b": "t"}))[1] == {("0", "a"): "duplicate_token", ("0", "b"): "duplicate_token"}
    assert parse(spark, json.dumps({"bad id": "t"}))[1] == {("0", "bad id"): "invalid_server_id"}


ISO = {
    "20260101": "2026-01-01T00:00:00", "2026-01-01": "2026-01-01T00:00:00", "2026-W01-1": "2025-12-29T00:00:00", "2026W011": "2025-12-29T00:00:00",
    "2026-W01": "2025-12-29T00:00:00", "2026-01-01T00:00:00,5": "2026-01-01T00:00:00.500000", "2026-01-01 12": "2026-01-01T12:00:00",
    "2026-01-01T12:30Z": "2026-01-01T12:30:00", "20260101T123015+0230": "2026-01-01T10:00:15", "2026-01-01T00:00:00-01:00": "2026-01-01T01:00:00",
    "2026-01-01T00:00:00.1234567": "2026-01-01T00:00:00.123456", "2026": None, "2026-1-1": None, "2026-01-01T00:00:00 Europe/Berlin": None,
    "2026-02-30": None, "2026-W54-1": None, "2026-01-01T24:30": None, "2026-01-01T1:00": None, "": None, "soon": None, "2026-01-01T": None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_iso_moments_do_not_depend_on_the_session(spark, zone):
    import datetime

    from pyspark.sql import functions as F

    from earshot.functions.text import iso_utc, utc_date
    from earshot.sources.registry import iso_moment

    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([(t,) for t in ISO], "t string").select("t", F.unix_micros(iso_moment(F.col("t"))).alias("us")).collect()
        for r in rows:
            want = ISO[r.t] and datetime.datetime.fromisoformat(ISO[r.t]).replace(tzinfo=datetime.UTC)
            assert r.us == (want and round(want.timestamp() * 1_000_000)), r.t
        stamp = spark.sql("SELECT timestamp_micros(1767225600123456) AS m").select(
            iso_utc(F.col("m"), True).alias("a"), iso_utc(F.col("m"), False).alias("b"), utc_date(F.col("m")).cast("string").alias("c")
        ).first()
        assert tuple(stamp) == ("2026-01-01T00:00:00.123Z", "2026-01-01T00:00:00Z", "2026-01-01")
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
