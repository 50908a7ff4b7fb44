"""Fixed-column structure files: reading atoms as rows, writing values and whole chains back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lines import numbered_lines


def wide_number(number: Column, width: int) -> Column:
    """A number in ``width`` columns: decimal as long as it fits, then hybrid-36 as other programs write it.

    Numbers from ``10 ** width`` count on in base 36 from ``A000...``, then from ``a000...``; five columns hold 87,440,031 and four
    2,436,111. Null is blank. An error names a number that no form holds, as a longer field would shift all columns after it.
    """
    n = number.cast("long")
    block = 26 * 36 ** (width - 1)
    over = n - F.lit(10**width)
    coded = F.conv((F.pmod(over, F.lit(block)) + F.lit(10 * 36 ** (width - 1))).cast("string"), 10, 36)
    text = F.when((n < 10**width) & (n > -(10 ** (width - 1))), F.lpad(n.cast("string"), width, " ")).when((over >= 0) & (over < block), coded).when((over >= 0) & (over < 2 * block), F.lower(coded))
    wrong = F.raise_error(F.concat(F.lit(f"a field of {width} columns doesn't hold "), n.cast("string"))).cast("string")
    return F.when(n.isNull(), F.lit(" " * width)).otherwise(F.coalesce(text, wrong))


def read_number(text: Column, width: int) -> Column:
    """The number that ``wide_number`` or a plain writer wrote in ``width`` columns; null where it is none."""
    t = F.trim(text)
    coded = t.rlike(f"^([A-Z][0-9A-Z]{{{width - 1}}}|[a-z][0-9a-z]{{{width - 1}}})$")
    place = F.conv(F.upper(t), 36, 10).cast("long") + F.when(t >= "a", F.lit(26 * 36 ** (width - 1))).otherwise(F.lit(0))
    return F.when(coded, (place + F.lit(10**width - 10 * 36 ** (width - 1))).cast("int")).otherwise(t.try_cast("int"))


# The columns of an atom line, from 1, both ends included.
FIELDS = (
    ("record", 1, 6, "string"), ("serial", 7, 11, "int"), ("name", 13, 16, "string"), ("altloc", 17, 17, "string"), ("resname", 18, 20, "string"), ("chain", 22, 22, "string"),
    ("resno", 23, 26, "int"), ("x", 31, 38, "double"), ("y", 39, 46, "double"), ("z", 47, 54, "double"), ("occ", 55, 60, "double"), ("b", 61, 66, "double"),
)


def atom_fields(line: Column) -> list[Column]:
    out = []
    for name, a, b, kind in FIELDS:
        text = F.substring(line, a, b - a + 1)
        text = text if name == "altloc" else F.trim(text)
        value = text if kind == "string" else read_number(text, b - a + 1) if kind == "int" else text.try_cast(kind)
        out.append(value.alias(name))
    return out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, line)`` of all lines that aren't empty; files are read by splits."""
    return numbered_lines(spark, path).where("line <> ''")


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """``(file, model, line_no, line)`` of files of several models: lines from a model's first to its last; a file without models has one, 1."""
    kind = lambda c: F.trim(F.substring(c, 1, 6))
    lines = numbered_lines(spark, path, section=kind("line") == "MODEL").where("line <> ''")
    ends = lines.where(kind("line") == "ENDMDL").groupBy("file", "section").agg(F.min("line_no").alias("_end"))
    kept = lines.join(ends, ["file", "section"], "left")
    inside = kept.where((F.col("_end").isNull() | (F.col("line_no") < F.col("_end"))) & ~kind("line").isin("MODEL", "ENDMDL"))
    several = lines.groupBy("file").agg((F.max("section") > 0).alias("_several"))
    out = inside.join(several, "file").where("section > 0 or not _several")
    return out.select("file", F.greatest("section", F.lit(1)).cast("int").alias("model"), "line_no", "line")


def atoms(lines: DataFrame, records: tuple[str, ...] = ("ATOM", "HETATM"), line: str = "line") -> DataFrame:
    """Atom lines with their fields beside them."""
    kind = F.trim(F.substring(line, 1, 6))
    return lines.where(kind.isin(*records)).select("*", *atom_fields(F.col(line)))


def representative(atom_rows: DataFrame, keys: list[str], chains: str | None = "ABCD", order: str = "line_no") -> DataFrame:
    """The first CB of each residue, or CA of a glycine, of the main place and a positive number; others have none."""
    want = F.when(F.col("resname") == "GLY", "CA").otherwise("CB")
    rows = atom_rows.where((F.col("name") == want) & F.col("altloc").isin(" ", "", "A") & (F.col("resno") > 0))
    if chains:
        rows = rows.where(F.col("chain").isin(*chains))
    return rows.groupBy(*keys, "chain", "resno").agg(F.min_by(F.struct("x", "y", "z"), order).alias("p")).select(*keys, "chain", "resno", "p.*")


def with_values(lines: DataFrame, field: DataFrame, chains: str = "ABCD", default: float = 0.0, line: str = "line", on: list[str] | None = None) -> DataFrame:
    """Lines whose columns 61-66 hold the residue's value, by the keys ``on`` besides if given: atoms of ``chains`` without one have ``default``, hetero atoms 0; other lines stay."""
    kind = F.trim(F.substring(line, 1, 6))
    chain, resno = F.substring(line, 22, 1), read_number(F.substring(line, 23, 4), 4)
    keyed = lines.withColumn("_chain", F.when(kind == "ATOM", chain)).withColumn("_resno", resno)
    on = on or []
    joined = keyed.join(field.select(*on, F.col("chain").alias("_chain"), F.col("resno").alias("_resno"), F.col("value").alias("_value")), [*on, "_chain", "_resno"], "left")
    ours = (kind == "ATOM") & chain.isin(*chains)
    value = F.when(ours, F.coalesce("_value", F.lit(default))).when(kind == "HETATM", F.lit(0.0))
    new = F.concat(F.rpad(F.substring(line, 1, 60), 60, " "), F.format_string("%6.2f", value), F.substring(line, 67, 200))
    return joined.withColumn(line, F.when(value.isNotNull(), new).otherwise(F.col(line))).drop("_chain", "_resno", "_value")


def atom_line(serial: Column, name: Column, resname: Column, chain: Column, resno: Column, x: Column, y: Column, z: Column, occ: Column, b: Column) -> Column:
    return F.format_string("ATOM  %s  %-3s %3s %1s%s    %8.3f%8.3f%8.3f%6.2f%6.2f", wide_number(serial, 5), name, resname, chain, wide_number(resno, 4), x, y, z, occ, b)


def strand_bonds(backbone: DataFrame, file: str) -> DataFrame:
    """``(file, chain, residue, at, serial, other)``: the bonds of a poly-glycine chain, within residues and to the next residue of the chain.

    Serials count from the chain's first atom, four a residue. The next residue is found by a window over the chain's
    residues; no bond leads over a gap or to an atom that is missing.
    """
    rank = F.array_position(F.array(*[F.lit(n) for n in NAMES]), F.col("name"))
    residue = backbone.groupBy(file, "chain", "residue").agg(*[F.max(F.when(F.col("name") == n, F.col("residue") * 4 + rank - 4)).alias(n) for n in NAMES])
    w = Window.partitionBy(file, "chain").orderBy("residue")
    after = F.when(F.lead("residue").over(w) == F.col("residue") + 1, F.lead("N").over(w))
    ends = (("N", "CA"), ("CA", "C"), ("C", "O"), ("C", "_after"))
    bonds = residue.withColumn("_after", after).select(file, "chain", "residue", F.posexplode(F.array(*[F.struct(F.col(x).alias("serial"), F.col(y).alias("other")) for x, y in ends])).alias("at", "b"))
    return bonds.select(file, "chain", "residue", "at", "b.*").where("serial is not null and other is not null")


#: The atoms of a residue's backbone in their order.
NAMES = ("N", "CA", "C", "O")


def strand_lines(backbone: DataFrame, file: str) -> DataFrame:
    """``(file, section, seq, line)`` of poly-glycine chains: remark, sheets, atoms and ends of chains, bonds, end; ordered by section and seq.

    ``backbone`` has ``chain, residue, name, x, y, z``. Serials count on from chain to chain, as bonds name atoms of
    the whole file by them: a chain begins after the end of the one before.
    """
    rank = F.array_position(F.array(*[F.lit(n) for n in NAMES]), F.col("name"))
    ends = backbone.groupBy(file, "chain").agg(F.max("residue").alias("n"))
    # a row a chain
    before = Window.partitionBy(file).orderBy("chain").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("base", F.coalesce(F.sum(F.col("n") * 4 + 1).over(before), F.lit(0)))
    placed = backbone.join(ends.select(file, "chain", "base"), [file, "chain"])
    serial = F.col("base") + F.col("residue") * 4 + rank - 4
    atom = placed.select(F.col(file).alias("file"), F.lit(3).alias("section"), F.concat_ws(":", "chain", F.lpad(serial.cast("string"), 9, "0")).alias("seq"), atom_line(serial.cast("int"), F.col("name"), F.lit("GLY"), F.col("chain"), F.col("residue"), F.col("x"), F.col("y"), F.col("z"), F.lit(1.0), F.lit(0.0)).alias("line"))
    ter = ends.select(F.col(file).alias("file"), F.lit(3).alias("section"), F.concat("chain", F.lit(":999999999")).alias("seq"), F.format_string("TER   %s      GLY %1s%s", wide_number(F.col("base") + F.col("n") * 4 + 1, 5), F.col("chain"), wide_number(F.col("n"), 4)).alias("line"))
    sheet = ends.select(F.col(file).alias("file"), F.lit(2).alias("section"), F.col("chain").alias("seq"), F.format_string("SHEET    1   %1s 1 GLY %1s%4d  GLY %1s%s  0", F.col("chain"), F.col("chain"), F.lit(1), F.col("chain"), wide_number(F.col("n"), 4)).alias("line"))
    tied = strand_bonds(backbone, file).join(ends.select(file, "chain", "base"), [file, "chain"])
    ties = F.concat(F.lit("CONECT"), *[wide_number(F.col("base") + F.col(c), 5) for c in ("serial", "other")])
    bonds = tied.select(F.col(file).alias("file"), F.lit(4).alias("section"), F.concat_ws(":", "chain", F.lpad(F.col("residue").cast("string"), 9, "0"), F.col("at").cast("string")).alias("seq"), ties.alias("line"))
    files = backbone.select(F.col(file).alias("file")).distinct()
    head = files.select("file", F.lit(1).alias("section"), F.lit("").alias("seq"), F.lit("REMARK   1 PATHS AS STRANDS").alias("line"))
    tail = files.select("file", F.lit(5).alias("section"), F.lit("").alias("seq"), F.lit("END").alias("line"))
    return head.unionByName(sheet).unionByName(atom).unionByName(ter).unionByName(bonds).unionByName(tail)


def write_lines(lines: DataFrame, path: str, order: list[str], by: str = "file", line: str = "line") -> None:
    """One text file a ``by`` value, its lines in order; a file is one task's."""
    lines.repartition(by).sortWithinPartitions(by, *order).select(by, F.col(line).alias("value")).write.partitionBy(by).text(path)
