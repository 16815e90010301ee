"""The commands from files to files."""

import pytest

from lacuna import cli
from lacuna.sources import profiles as P
from tests.simulate import cohort
from tests.test_profile import records


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cli")
    reads, contigs, _ = records(spark)
    reads.write.parquet(str(folder / "reads"))
    contigs.write.parquet(str(folder / "contigs"))
    (folder / "sampling.txt").write_text("chr1:1-15000 chrZ:1-5\n")
    return folder


def test_profile_and_view(folder, capsys):
    args = ["profile", str(folder / "reads"), "--contigs", str(folder / "contigs"), "-i", str(folder / "sampling.txt"), "-n", "500", "-o", str(folder / "p")]
    assert cli.main(args) == 0
    assert "no contig" in (said := capsys.readouterr().err) or "'chrZ'" in said
    assert cli.main(args) == 1 and "already" in capsys.readouterr().err
    assert cli.main(["view", str(folder / "p")]) == 1 and "--sample" in capsys.readouterr().err
    assert cli.main(["view", str(folder / "p"), "-s", "a", "-e", "-r", "chr1:1000-3000"]) == 0
    shown = capsys.readouterr().out.splitlines()
    assert shown[1] == "@RG\tID:a1" and "@RG\tID:b1" not in shown
    assert cli.main(["view", str(folder / "p"), "-s", "a", "-e", "-r", "chr1:1000-3000", "-t", str(folder / "text")]) == 0
    parts = [p for name in ("header", "lines") for p in sorted((folder / "text" / name).glob("part-*"))]
    assert "".join(p.read_text() for p in parts).splitlines() == shown


def test_call(spark, folder, capsys):
    P.write_profile(cohort(spark, [(12_000, 600, {0: 1, 1: 2})], n_samples=3, length=20_000), str(folder / "cohort"))
    out = folder / "calls.vcf"
    assert cli.main(["call", str(folder / "cohort"), "-o", str(out)]) == 0, capsys.readouterr().err
    lines = out.read_text().splitlines()
    assert lines[0].startswith("##fileformat=VCF")
    assert [x.split("\t")[4] for x in lines if not x.startswith("#")] == ["<DEL>"]
