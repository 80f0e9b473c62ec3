"""tarnflow: terrain-water analytics and large-table data processing on PySpark."""

from tarnflow.operators.dynamics import EventLog, complete_spill_graph, compute_flow, fill_sequence, interpolate_timeseries, trap_states_at, update_spill_graph
from tarnflow.operators.field import hconcat_fields, spill_field, update_spill_field, vconcat_fields
from tarnflow.operators.flat import flatten_grid, identify_flat_areas
from tarnflow.operators.flow import all_subtraps_of, all_upstream_regions, region_selection, saturated_spill_graph, upstream_area, watercourses
from tarnflow.operators.geometry import mesh_geometry
from tarnflow.operators.hierarchy import ancestor_pairs, resolve_hierarchy
from tarnflow.operators.hotkeys import exact_quantiles, frequent_keys, key_profile
from tarnflow.operators.regions import spill_regions, update_spill_regions
from tarnflow.operators.snapshots import SnapshotIndex, snapshot_changes
from tarnflow.operators.spill import region_adjacency, spill_points
from tarnflow.operators.traps import TrapStructure, analyze, trap_hierarchy, trap_volumes
from tarnflow.sources.grid import Domain, Raster, load_grid, raster_from_cells, save_grid, tile_domain, tiles

__version__ = "0.1.0"
__all__ = [
    "Domain", "EventLog", "Raster", "SnapshotIndex", "TrapStructure", "all_subtraps_of", "all_upstream_regions", "analyze",
    "ancestor_pairs", "complete_spill_graph", "compute_flow", "exact_quantiles", "fill_sequence", "flatten_grid", "hconcat_fields",
    "frequent_keys", "identify_flat_areas", "interpolate_timeseries", "key_profile", "load_grid", "mesh_geometry", "raster_from_cells",
    "region_adjacency", "region_selection", "resolve_hierarchy", "saturated_spill_graph", "save_grid", "snapshot_changes",
    "spill_field", "spill_points", "spill_regions", "tile_domain", "tiles", "trap_hierarchy", "trap_states_at", "trap_volumes",
    "update_spill_field", "update_spill_graph", "update_spill_regions", "upstream_area", "vconcat_fields", "watercourses",
]
