import shutil

import pytest

from tarnlink.plans import company, metrics
from tarnlink.plans.settings import Settings
from tarnlink.sources import catalog


def record(abn, name, state="NSW"):
    return f'<ABR><ABN status="ACT">{abn}</ABN><EntityType><EntityTypeText>PRV</EntityTypeText></EntityType><MainEntity><NonIndividualName><NonIndividualNameText>{name}</NonIndividualNameText></NonIndividualName><BusinessAddress><AddressDetails><State>{state}</State><Postcode>0800</Postcode></AddressDetails></BusinessAddress></MainEntity><ABNStatusFromDate>20200131</ABNStatusFromDate></ABR>'


def test_flow_twice(spark, tmp_path):
    (tmp_path / "reg").mkdir()
    (tmp_path / "reg/a.xml").write_text(f"<T>{record('12345678901', 'Acme Pty Ltd')}{record('12345678902', 'Zenith Co')}{record('bad', 'X')}</T>")
    pages = [("https://acme.example", "<title>Home - Acme Ltd Pty</title><meta name='keywords' content='tools'>"), ("https://none.example", "<p>x</p>")]
    spark.createDataFrame(pages, "url string, html string").write.parquet(str(tmp_path / "web"))
    s = Settings.of(spark, {"TARNLINK_REGISTER_DIR": str(tmp_path / "reg"), "TARNLINK_WEB_DIR": str(tmp_path / "web"), "TARNLINK_TARGET_DIR": str(tmp_path / "out")})
    for _ in range(2):
        got = company.company_flow(spark, s)
        rows = got["matches_table"].collect()
        assert [(r["abn"], r["url"], r["match_confidence"], r["industry"], str(r["start_date"]), r["address"]) for r in rows] == [("12345678901", "https://acme.example", 100.0, "tools", "2020-01-31", "NSW 0800")]
        assert got["register_table"].count() == 2 and got["web_table"].count() == 1


def test_extracts_are_kept_and_stops_lose_nothing(spark, tmp_path, monkeypatch):
    from tarnlink.sources import versions

    (tmp_path / "reg").mkdir()
    (tmp_path / "reg/a.xml").write_text(f"<T>{record('12345678901', 'Acme Pty Ltd')}</T>")
    spark.createDataFrame([("https://acme.example", "<title>Acme Pty Ltd</title>")], "url string, html string").write.parquet(str(tmp_path / "web"))
    s = Settings.of(spark, {"TARNLINK_REGISTER_DIR": str(tmp_path / "reg"), "TARNLINK_WEB_DIR": str(tmp_path / "web"), "TARNLINK_TARGET_DIR": str(tmp_path / "out")})
    company.company_flow(spark, s)
    (tmp_path / "reg/a.xml").write_text(f"<T>{record('12345678909', 'Other')}</T>")
    assert company.company_flow(spark, s)["register_raw"].first()["abn"] == "12345678901"  # not read again
    shutil.rmtree(tmp_path / "out/extract/web")
    with monkeypatch.context() as m:
        m.setattr(versions.Versions, "_commit", lambda self, number: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            company.company_flow(spark, s)
    assert versions.Versions(spark, f"{s.target_dir}/register").read().count() == 1
    got = company.company_flow(spark, s)
    assert {r["abn"] for r in got["register_table"].collect()} == {"12345678901", "12345678909"} and got["matches_table"].count() == 1
    assert len(got["matches_table"].columns) == 14


def test_scripts_and_pages(spark):
    n = catalog.run_script(spark, "create schema if not exists raw_x; -- note; here\ncreate table if not exists raw_x.t (a string, b int) using parquet; insert into raw_x.t values ('x;y', 1), ('z', 2);")
    assert n == 3
    catalog.optimize(spark, "raw_x.t", ["b"])
    assert [r["a"] for r in catalog.page(spark.table("raw_x.t"), ["b"], 1, 1).collect()] == ["z"]
    spark.sql("drop schema raw_x cascade")


def test_throughput(spark):
    got = metrics.measured(spark.range(1000), lambda df: df.write.format("noop").mode("overwrite").save())
    assert got.rows == 1000 and got.rows_per_second > 0
