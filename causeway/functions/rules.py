"""Units and physical rules: small dimension tables met by broadcast joins or literal maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions import lexicons as lx


def _map(values: dict[str, float]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))])


def _checked(value: Column, unit: Column, what: str, strict: bool) -> Column:
    if not strict:
        return value
    return F.when(value.isNull() & unit.isNotNull(), F.raise_error(F.concat(F.lit(f"unknown {what} unit: "), unit)).cast("double")).otherwise(value)


def celsius(value: Column, unit: Column, strict: bool = False) -> Column:
    """Degrees Celsius; unknown units give null, or raise if ``strict``."""
    u = F.upper(F.trim(unit))
    v = value.cast("double")
    out = F.when(u.isin("C", "CELSIUS", "DEGC"), v).when(u.isin("K", "KELVIN"), v - 273.15).when(u.isin("F", "FAHRENHEIT"), (v - 32.0) * 5.0 / 9.0)
    return _checked(out, unit, "temperature", strict)


def pascal(value: Column, unit: Column, strict: bool = False) -> Column:
    """Pascal; exact spelling first, then any case."""
    u = F.trim(unit)
    any_case: dict[str, float] = {}
    for k, v in lx.PRESSURE_UNITS.items():
        any_case.setdefault(k.lower(), v)
    factor = F.coalesce(F.try_element_at(_map(lx.PRESSURE_UNITS), u), F.try_element_at(_map(any_case), F.lower(u)))
    return _checked(value.cast("double") * factor, unit, "pressure", strict)


def seconds(value: Column, unit: Column, strict: bool = False) -> Column:
    out = value.cast("double") * F.try_element_at(_map(lx.TIME_UNITS), F.lower(F.trim(unit)))
    return _checked(out, unit, "time", strict)


def rule_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The rules as tables of fixed size."""
    return {
        "ranges": spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in lx.MATERIAL_RANGES.items()], "material string, low double, high double"),
        "limits": spark.createDataFrame([(k, float(v)) for k, v in lx.SUBSTRATE_LIMITS.items()], "substrate string, most double"),
        "dopants": spark.createDataFrame([(a, d, ok) for a, own in lx.ATMOSPHERE_DOPANTS.items() for d, ok in own.items()], "atmosphere string, dopant string, works boolean"),
        "precursors": spark.createDataFrame([(p, s) for p, own in lx.PRECURSOR_SUBSTRATES.items() for s in own], "precursor string, substrate string"),
    }


def validate_conditions(conditions: DataFrame) -> DataFrame:
    """Five checks per row of (material, temperature_c, substrate, atmosphere, dopant, precursor, ...). What no rule
    knows passes; a missing temperature counts as 0."""
    t = rule_tables(conditions.sparkSession)
    heat = F.coalesce("temperature_c", F.lit(0.0))
    known = t["precursors"].select("precursor").distinct().withColumn("known", F.lit(True))
    pairs = t["precursors"].withColumn("pair", F.lit(True))
    out = (
        conditions.join(F.broadcast(t["ranges"]), "material", "left")
        .join(F.broadcast(t["limits"]), "substrate", "left")
        .join(F.broadcast(t["dopants"]), ["atmosphere", "dopant"], "left")
        .join(F.broadcast(known), "precursor", "left")
        .join(F.broadcast(pairs), ["precursor", "substrate"], "left")
    )
    checks = {
        "temperature_in_range": F.coalesce(heat.between(F.col("low"), F.col("high")), F.lit(True)),
        "substrate_temperature_ok": F.coalesce(heat <= F.col("most"), F.lit(True)),
        "atmosphere_dopant_compatible": F.coalesce("works", F.lit(True)),
        "precursor_substrate_compatible": F.col("known").isNull() | F.col("pair").isNotNull() | (F.coalesce("substrate", F.lit("")) == ""),
    }
    out = out.select(*conditions.columns, *[v.alias(k) for k, v in checks.items()])
    return out.withColumn("overall_valid", F.col("temperature_in_range") & F.col("substrate_temperature_ok") & F.col("atmosphere_dopant_compatible") & F.col("precursor_substrate_compatible"))


def thermally_stable(material: Column, temperature: Column) -> Column:
    """Whether a temperature is in the material's range; unknown materials are taken as stable."""
    low = F.try_element_at(_map({k: a for k, (a, _) in lx.MATERIAL_RANGES.items()}), material)
    high = F.try_element_at(_map({k: b for k, (_, b) in lx.MATERIAL_RANGES.items()}), material)
    return F.coalesce(temperature.between(low, high), F.lit(True))


def composition_compatible(precursor: Column, substrate: Column) -> Column:
    """Whether a precursor works on a substrate; unknown precursors do."""
    table = F.create_map(*[x for k, v in lx.PRECURSOR_SUBSTRATES.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    return F.coalesce(F.array_contains(F.try_element_at(table, precursor), substrate), F.lit(True))
