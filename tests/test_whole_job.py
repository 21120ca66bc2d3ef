"""The whole job over written phases: what stays after a lost driver, and what uploads are refused."""

import pytest

from sievekit.plans.catalog_job import order_uploads
from sievekit.plans.whole_job import PHASES, committed, judged, run_job
from sievekit.sources.files import file_documents

SMALL = "/root/testdata/sf0.001"
UPLOADS = "doc_id long, source_id string, name string, text string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_rerun_after_a_killed_phase_gives_the_same_rows(spark, tmp_path):
    uploads = order_uploads(spark, SMALL).filter("doc_id < 400")
    whole = rows(run_job(spark, uploads, f"{tmp_path}/whole"))
    ran = []

    def logged(name):
        def phase(read):
            ran.append(name)
            return PHASES[name](read)
        return phase

    def killed(read):
        read("rows").limit(5).write.mode("overwrite").parquet(f"{tmp_path}/cut/grouped")
        (tmp_path / "cut" / "grouped" / "_SUCCESS").rename(tmp_path / "cut" / "half")  # half written, never committed
        raise RuntimeError("driver lost")

    with pytest.raises(RuntimeError):
        run_job(spark, uploads, f"{tmp_path}/cut", {n: logged(n) for n in PHASES} | {"grouped": killed})
    before = list(ran)
    assert before[-1] == "documents" and committed(spark, f"{tmp_path}/cut/documents") and not committed(spark, f"{tmp_path}/cut/grouped")
    assert rows(run_job(spark, uploads, f"{tmp_path}/cut", {n: logged(n) for n in PHASES})) == whole
    assert ran == list(PHASES)  # every phase once
    for phase in ("documents", "tables"):
        assert rows(spark.read.parquet(f"{tmp_path}/cut/{phase}")) == rows(spark.read.parquet(f"{tmp_path}/whole/{phase}"))


def test_refused_uploads_have_a_reason(spark):
    given = [
        (1, "a", "x.md", "k: 1"), (2, None, "x.md", "k: 1"), (3, "a b", "x.md", "k: 1"), (4, "a" * 61, "x.md", "k: 1"),
        (5, "a", "x.exe", "k: 1"), (6, "a", None, "k: 1"), (7, "a", "X.TXT", " \t"), (8, "a", "x.md", None),
    ]
    got = {r["doc_id"]: r["reason"] for r in judged(spark.createDataFrame(given, UPLOADS)).collect()}
    assert got[1] is None and "required" in got[2] and "invalid" in got[3] and "too long" in got[4]
    assert got[5] == "unsupported file type: .exe" and got[6] is not None and got[8] == "empty document" and len(got) == 8


@pytest.mark.parametrize("given", [[], [(1, "a b", "x.md", "k: 1")], [(1, "a", "x.md", "no fragment here")]])
def test_jobs_without_records(spark, tmp_path, given):
    got = {r["source_id"]: r for r in run_job(spark, spark.createDataFrame(given, UPLOADS), str(tmp_path)).filter("phase = 'inserted'").collect()}
    assert len(got) == len(given) and all(r["n"] == 0 and r["status"] == "empty" for r in got.values())


def test_files_as_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("zwölf\n".encode())
    (tmp_path / "sub" / "b.MD").write_bytes(b"\n")
    (tmp_path / "c.md").write_bytes(b"ok \xff\xfe")
    (tmp_path / "e.md").write_bytes(b"")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    got = {r["name"].rsplit("/", 1)[1]: r for r in file_documents(spark, f"file://{tmp_path}").collect()}
    assert sorted(got) == ["a.txt", "b.MD", "c.md", "d.pdf"]  # an empty file gives no row
    assert got["a.txt"]["text"] == "zwölf\n" and got["a.txt"]["n_bytes"] == 7 and got["a.txt"]["source_id"].startswith("a_")
    assert got["b.MD"]["text"] == "\n" and got["b.MD"]["reason"] is None
    assert got["c.md"]["text"] is None and got["c.md"]["reason"] == "not UTF-8" and got["d.pdf"]["reason"] == "unsupported file type: .pdf"
