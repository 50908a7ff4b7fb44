"""Text files of several splits: numbers, models, matrices; the six kinds of record of a structure of strands."""

import pytest

from pyspark.sql import functions as F

from strandline.sources import lines, pdb, tables


@pytest.fixture
def small_splits(spark):
    """Splits of 64 bytes, so that short files have many."""
    conf = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "0"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k in conf:
        spark.conf.unset(k)


def test_numbers_of_several_splits(small_splits, tmp_path):
    texts = {"a.txt": "".join(f"line {k}\n" if k % 7 else "\n" for k in range(300)), "b.txt": "x" * 500 + "\nshort\r\n\nlast without end", "c.txt": "", "d.txt": "\n\n\n", "e.txt": "é" * 40 + "\n" + "日本" * 30 + "\nz\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    df = lines.numbered_lines(small_splits, str(tmp_path))
    assert small_splits.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = {}
    for r in df.collect():
        got.setdefault(r.file.rsplit("/", 1)[1], {})[r.line_no] = r.line
    want = {n: dict(enumerate(t.replace("\r\n", "\n").removesuffix("\n").split("\n"))) for n, t in texts.items() if t}
    assert got == want
    filled = lines.numbered_lines(small_splits, str(tmp_path / "a.txt"), blank=False).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in filled] == list(enumerate(x for x in texts["a.txt"].split("\n") if x))


def test_models(small_splits, tmp_path):
    atom = "ATOM  {:5d}  CA  GLY A{:4d}    {:8.3f}{:8.3f}{:8.3f}{:6.2f}{:6.2f}"
    body = lambda m: "\n".join(atom.format(k, k, m, 0.0, 0.0, 1.0, 0.0) for k in range(1, 6))
    (tmp_path / "many.pdb").write_text("REMARK no model\n" + "".join(f"MODEL     {m:4d}\n{body(m)}\nENDMDL\nREMARK between\n" for m in range(1, 8)) + "END\n")
    (tmp_path / "one.pdb").write_text(f"REMARK kept\n{body(9)}\nEND\n")
    rows = pdb.atoms(pdb.read_models(small_splits, str(tmp_path))).collect()
    got = {}
    for r in rows:
        got.setdefault((r.file.rsplit("/", 1)[1], r.model), []).append((r.resno, r.x))
    want = {("many.pdb", m): [(k, float(m)) for k in range(1, 6)] for m in range(1, 8)} | {("one.pdb", 1): [(k, 9.0) for k in range(1, 6)]}
    assert {k: sorted(v) for k, v in got.items()} == want
    kinds = {(r.file.rsplit("/", 1)[1], r.line[:6].strip()) for r in pdb.read_models(small_splits, str(tmp_path)).collect()}
    assert ("one.pdb", "REMARK") in kinds and not any(k in ("MODEL", "ENDMDL") for _, k in kinds) and ("many.pdb", "REMARK") not in kinds


def test_matrices_of_several_splits(small_splits, tmp_path):
    names = [f"n{k}" for k in range(20)]
    want = {(f"{kind}.csv", a, b): i * 100.0 + j for kind in ("named", "bare") for i, a in enumerate(names) for j, b in enumerate(names)}
    rows = lambda named: [",".join(([f'"{a}"'] if named else []) + [str(want["named.csv", a, b]) for b in names]) for a in names]
    (tmp_path / "named.csv").write_text('"",' + ",".join(f'"{n}"' for n in names) + "\n" + "\n".join(rows(True)) + "\n")
    (tmp_path / "bare.csv").write_text(",".join(names) + "\n\n" + "\n".join(rows(False)))
    got = {(r.file.rsplit("/", 1)[1], r.i, r.j): r.value for r in tables.read_matrix(small_splits, str(tmp_path)).collect()}
    assert got == want


def test_records_of_strands(spark):
    rows = [("f", c, r, n, float(r), float(k), 0.5) for c, size in (("A", 2), ("B", 1)) for r in range(1, size + 1) for k, n in enumerate(("N", "CA", "C", "O"))]
    got = [x.line for x in pdb.strand_lines(spark.createDataFrame(rows, "file string, chain string, residue int, name string, x double, y double, z double"), "file").orderBy("section", "seq").collect()]
    atom = "ATOM  {:5d}  {:<3s} GLY {}{:4d}    {:8.3f}{:8.3f}   0.500  1.00  0.00"
    want = ["REMARK   1 PATHS AS STRANDS", "SHEET    1   A 1 GLY A   1  GLY A   2  0", "SHEET    1   B 1 GLY B   1  GLY B   1  0"]
    want += [atom.format(4 * r - 3 + k, n, "A", r, r, k) for r in (1, 2) for k, n in enumerate(("N", "CA", "C", "O"))] + ["TER       9      GLY A   2"]
    want += [atom.format(10 + k, n, "B", 1, 1, k) for k, n in enumerate(("N", "CA", "C", "O"))] + ["TER      14      GLY B   1"]
    want += [f"CONECT{a:5d}{b:5d}" for a, b in ((1, 2), (2, 3), (3, 4), (3, 5), (5, 6), (6, 7), (7, 8), (10, 11), (11, 12), (12, 13))] + ["END"]
    assert got == want


def test_no_bond_over_a_gap(spark):
    rows = [("f", "A", r, n) for r in (1, 2, 4) for n in ("N", "CA", "C", "O") if (r, n) != (2, "O")]
    got = sorted((x.serial, x.other) for x in pdb.strand_bonds(spark.createDataFrame(rows, "file string, chain string, residue int, name string"), "file").collect())
    assert got == [(1, 2), (2, 3), (3, 4), (3, 5), (5, 6), (6, 7), (13, 14), (14, 15), (15, 16)]


def test_numbers_wider_than_their_columns(spark):
    """Serials from 100,000 and residues from 10,000 are hybrid-36, so no column shifts, and are read as they were."""
    serials = [None, 1, 99_999, 100_000, 1_199_999, 100_000 + 26 * 36**4 - 1, 100_000 + 26 * 36**4, 87_440_031]
    residues = [-999, 0, 9_999, 10_000, 10_000 + 26 * 36**3 - 1, 10_000 + 26 * 36**3, 2_436_111, 7]
    rows = spark.createDataFrame(list(zip(range(8), serials, residues, strict=True)), "line_no long, s int, r int")
    line = pdb.atom_line(F.col("s"), F.lit("CA"), F.lit("ALA"), F.lit("B"), F.col("r"), F.lit(1.5), F.lit(-2.0), F.lit(3.25), F.lit(1.0), F.lit(0.0))
    lines = rows.select("line_no", line.alias("line"))
    got = pdb.atoms(lines).orderBy("line_no").collect()
    assert {len(x.line) for x in got} == {66}
    assert [(x.serial, x.resno, x.chain, x.x, x.z) for x in got] == [(s, r, "B", 1.5, 3.25) for s, r in zip(serials, residues, strict=True)]
    assert [x.line[6:11] for x in got] == ["     ", "    1", "99999", "A0000", got[4].line[6:11], "ZZZZZ", "a0000", "zzzzz"]
    values = pdb.with_values(lines, rows.select(F.lit("B").alias("chain"), F.col("r").alias("resno"), F.col("line_no").cast("double").alias("value")))
    assert [x.line[60:66] for x in values.orderBy("line_no").collect()] == [f"{k:6.2f}" for k in range(8)]
    for wrong in (87_440_032, -10_000):
        with pytest.raises(Exception, match="5 columns"):
            spark.range(1).select(pdb.wide_number(F.lit(wrong), 5)).collect()
