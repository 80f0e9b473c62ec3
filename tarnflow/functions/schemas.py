"""Schemas of the records that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_LONG, _DOUBLE, _BOOL = T.LongType(), T.DoubleType(), T.BooleanType()

CELL = _struct(cell_id=_LONG, i=_LONG, j=_LONG, z=_DOUBLE, dir=T.ByteType(), slope=_DOUBLE, region=_LONG)
DOMAIN = _struct(i_lo=_LONG, i_hi=_LONG, j_lo=_LONG, j_hi=_LONG)
SPILLPOINT = _struct(downstream_region=_LONG, current_region_cell=_LONG, downstream_region_cell=_LONG, elevation=_DOUBLE)
BOUNDARY = _struct(src=_LONG, dst=_LONG, z_pass=_DOUBLE, cell=_LONG, ncell=_LONG)
TRAP = _struct(trap=_LONG, parent=_LONG, elevation=_DOUBLE, downstream_region=_LONG, current_region_cell=_LONG, downstream_region_cell=_LONG, level=T.IntegerType())
WEATHER_EVENT = _struct(t=_DOUBLE, rain_rate=_DOUBLE)
FILLED_AMOUNT = _struct(amount=_DOUBLE, time=_DOUBLE)
CHANGE_TIME_ESTIMATE = _struct(filling=_BOOL, earliest=_DOUBLE, latest=_DOUBLE)
SPILL_EVENT = _struct(event_ix=_LONG, t=_DOUBLE, is_snapshot=_BOOL, rain_rate=_DOUBLE)
TRAP_UPDATE = _struct(event_ix=_LONG, trap=_LONG, amount=_DOUBLE, amount_t=_DOUBLE, filled=_BOOL, inflow=_DOUBLE)
RUNOFF_UPDATE = _struct(event_ix=_LONG, cell_id=_LONG, runoff=_DOUBLE)
SPILL_EDGE = _struct(trap=_LONG, target=_LONG)
RATE_INFO = _struct(trap=_LONG, inflow=_DOUBLE, smin=_DOUBLE, smax=_DOUBLE)
