"""Studies of structures: normal-mode tables, deformation on all atoms, ligand distances, bending of helices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance, mid_vector_angle, triangle_angle
from ..functions.labels import shift_chain
from ..operators import dynamics, modes, series
from ..sources.sinks import write_table

# Pairs of a residue's atom and an atom of the ligand, which is residue 3000, by variant.
LIGAND = 3000
LIGAND_ATOMS = ((700, "NE2", "O10"), (557, "NH1", "O10"), (570, "OE1", "O10"), (554, "N", "O12"), (512, "OG", "O12"), (511, "CE2", "C6"), (550, "OG1", "N21"), (551, "OD1", "N21"), (511, "OH", "O23"))
LIGAND_VARIANTS = ("WT", "W426A", "W697A", "Y441A")


def ligand_pairs(variant: str) -> tuple[tuple[int, str, str], ...]:
    """The atom pairs of a variant; an unknown one fails."""
    if variant not in LIGAND_VARIANTS:
        raise ValueError(f"no ligand pairs for variant {variant}")
    return LIGAND_ATOMS


def ligand_label(resno: Column, name: Column, ligand: Column) -> Column:
    """``557_NH1_Cap_O10``."""
    return F.concat_ws("_", resno.cast("string"), name, F.lit("Cap"), ligand)


def ligand_distances(atoms: DataFrame, keys: list[str], pairs: tuple[tuple[int, str, str], ...], shift: int = 0, ligand: int = LIGAND) -> DataFrame:
    """``(keys, chain, pair, d)``: distances of residues' atoms to a ligand's in the chain ``shift`` places on, in each frame.

    ``atoms`` is ``(keys, chain, resno, name, x, y, z)``; of atoms of equal chain, number and name in a frame the first by place counts.
    """
    one = atoms.groupBy(*keys, "chain", "resno", "name").agg(F.min(F.struct("x", "y", "z")).alias("p")).select(*keys, "chain", "resno", "name", "p.*")
    wanted = F.array(*[F.struct(F.lit(r).alias("resno"), F.lit(n).alias("name"), F.lit(o).alias("other")) for r, n, o in pairs])
    a = one.where(F.col("resno") != ligand).withColumn("_w", F.explode(F.filter(wanted, lambda w: (w["resno"] == F.col("resno")) & (w["name"] == F.col("name")))))
    a = a.select(*keys, "chain", shift_chain(F.col("chain"), shift).alias("_c"), "resno", F.col("name"), F.col("_w.other").alias("other"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = one.where(F.col("resno") == ligand).select(*keys, F.col("chain").alias("_c"), F.col("name").alias("other"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    found = a.join(b, [*keys, "_c", "other"])
    return found.select(*keys, "chain", ligand_label(F.col("resno"), F.col("name"), F.col("other")).alias("pair"), distance(["ax", "ay", "az"], ["bx", "by", "bz"]).alias("d"))


def ligand_series(atoms: DataFrame, keys: list[str], pairs: tuple[tuple[int, str, str], ...], shift: int = 0) -> DataFrame:
    """Mean, deviation and number over chains of each pair's distance in each frame."""
    return series.summary(ligand_distances(atoms, keys, pairs, shift), [*keys, "pair"], "d")


def mode_tables(mode_rows: DataFrame, atoms: DataFrame, key: str) -> dict[str, DataFrame]:
    """What a mode study leaves: modes, their values and running share, fluctuations, correlation, and the path along the softest mode."""
    values = mode_rows.where(F.col("mode") > modes.TRIVIAL).select(key, "mode", "eigenvalue", (1 / F.col("eigenvalue")).alias("spread"))
    return {
        "modes": mode_rows, "values": series.cumulative_share(values, [key], "mode", "spread"), "fluctuations": modes.fluctuations(mode_rows, key),
        "correlation": modes.mode_correlation(mode_rows, key), "softest": mode_rows.where(F.col("mode") == modes.TRIVIAL + 1), "path": modes.mode_path(mode_rows, atoms, key),
    }


def write_mode_tables(tables: dict[str, DataFrame], path: str, key: str, policy: str = "overwrite") -> dict[str, str]:
    """Each table to its own folder, parted by ``key``; what fails is named with its reason and doesn't stop the others."""
    failed = {}
    for name, df in tables.items():
        try:
            write_table(df, f"{path}/{name}", [key], policy)
        except Exception as reason:  # noqa: BLE001
            failed[name] = str(reason)
    return failed


def on_all_atoms(values: DataFrame, atoms: DataFrame, anchors: DataFrame, key: str, low: int, high: int, value: str = "value") -> DataFrame:
    """``atoms`` of residues in ``[low, high]`` with their residue's value, 0 where it has none.

    Where no residue number of a key's ``values`` stands in its ``atoms``, the CA atoms of ``anchors`` and
    of ``atoms`` are matched in their order; if ``atoms`` has fewer, all values are 0. ``values`` is
    ``(key, resno, value)``, the others ``(key, serial, name, resno)``.
    """
    inside = lambda df: df.where(F.col("resno").between(low, high))
    v, full, thin = inside(values).select(key, "resno", value), inside(atoms), inside(anchors)
    turn = F.row_number().over(Window.partitionBy(key).orderBy("serial"))
    count = F.count("*").over(Window.partitionBy(key))
    direct = v.join(full.select(key, "resno").distinct(), [key, "resno"], "left_semi").select(key).distinct().withColumn("_direct", F.lit(True))
    a = thin.where("name = 'CA'").select(key, F.col("resno").alias("_thin"), turn.alias("_k"), count.alias("_n"))
    b = full.where("name = 'CA'").select(key, F.col("resno").alias("_full"), turn.alias("_k"), count.alias("_m"))
    mapped = a.join(b, [key, "_k"]).where("_m >= _n").groupBy(key, F.col("_thin").alias("resno")).agg(F.min_by("_full", "_k").alias("_full"))
    placed = v.join(direct, key, "left").join(mapped, [key, "resno"], "left").select(key, F.when(F.col("_direct"), F.col("resno")).otherwise(F.col("_full")).alias("resno"), value).where("resno is not null")
    placed = placed.groupBy(key, "resno").agg(F.first(value).alias(value))
    return full.join(placed, [key, "resno"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def bending_study(points: DataFrame, keys: list[str], order: str) -> dict[str, DataFrame]:
    """Bends of each helix: at each atom, of its halves, at its farthest corner, and their common range over all.

    ``points`` is ``(keys, order, x, y, z)``.
    """
    local = dynamics.local_bend(points, keys, order)
    whole = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "x", "y", "z"))).alias("points"))
    both = whole.select(*keys, mid_vector_angle("points").alias("halves"), triangle_angle("points").alias("corner"))
    top = both.agg(*[F.min(c).alias(f"{c}_low") for c in ("halves", "corner")], *[F.max(c).alias(f"{c}_high") for c in ("halves", "corner")])
    return {"local": local, "whole": both, "ranges": top.crossJoin(local.agg(F.min("bend").alias("local_low"), F.max("bend").alias("local_high")))}
