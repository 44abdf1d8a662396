"""The star schema: one sales fact, four dimensions and a returns fact.

Keys decide whether a result is right, so they are spelled out here:

* ``ft_vendas.IDProduto`` points at ``dim_produto.IDSK`` (the version sold);
* ``ft_vendas.IDCliente`` and ``IDVendedor`` hold *natural* keys, so the latest
  version of the customer or seller applies;
* ``ft_vendas.IDTempo`` points at ``dim_tempo.IDSK``.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType,
    DecimalType,
    LongType,
    StringType,
    StructField,
    StructType,
)

MONEY = DecimalType(18, 4)
PERCENT = DecimalType(9, 4)


def _table(**columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


SCHEMAS: dict[str, StructType] = {
    "ft_vendas": _table(
        IDTempo=LongType(), IDProduto=LongType(), IDCliente=LongType(), IDVendedor=LongType(),
        IDPed=LongType(), Quant=MONEY, TotLiq=MONEY, PrVenda=MONEY,
    ),
    "dim_produto": _table(
        IDSK=LongType(), IDProduto=LongType(), Cod=StringType(), Descri=StringType(),
        Grupo=StringType(), SubGrp=StringType(), Margem=PERCENT, Uprc=MONEY,
    ),
    "dim_cliente": _table(IDSK=LongType(), IDCliente=LongType(), Est=StringType()),
    "dim_vendedor": _table(
        IDSK=LongType(), IDVendedor=LongType(), Nome=StringType(), Equipe=StringType(),
        Mun=StringType(),
    ),
    "dim_tempo": _table(IDSK=LongType(), Data=DateType(), NomeMes=StringType()),
    "ft_trocas": _table(IDPed=LongType(), IDProduto=LongType(), TotLiq=MONEY),
}


@dataclass(frozen=True)
class StarSchema:
    """The six tables, as lazy DataFrames."""

    ft_vendas: DataFrame
    dim_produto: DataFrame
    dim_cliente: DataFrame
    dim_vendedor: DataFrame
    dim_tempo: DataFrame
    ft_trocas: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def calendar(self, since: Column | None = None) -> DataFrame:
        """Calendar rows, optionally from a date on, marked for broadcast.

        The table has one row per day, so its size is bounded by the calendar
        (about 36,500 rows a century) and not by the data. Filtering it before
        the join also lets Spark prune a sales table partitioned by ``IDTempo``.
        """
        days = self.dim_tempo.select(F.col("IDSK").alias("IDTempo"), "Data", "NomeMes")
        return F.broadcast(days if since is None else days.filter(F.col("Data") >= since))


def conform(name: str, df: DataFrame) -> DataFrame:
    """Select a table's declared columns; refuse missing columns and wrong types."""
    wanted = SCHEMAS[name]
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in wanted if f.name not in have]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    wrong = [
        f"{f.name} is {have[f.name].simpleString()}, expected {f.dataType.simpleString()}"
        for f in wanted
        if have[f.name] != f.dataType
    ]
    if wrong:
        raise ValueError(f"{name}: {'; '.join(wrong)}")
    return df.select(*wanted.names)
