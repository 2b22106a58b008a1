"""Sources and sinks: staging CSV scans, seeds, calendar, warehouse tables,
and the adapter that maps the driver's test tables onto the star schema."""
from finlake.sources.seed import product_seed
from finlake.sources.calendar import calendar, calendar_spanning
from finlake.sources.staging import read_staging, write_table, read_table
from finlake.sources.testdata import star_from_testdata

__all__ = ["product_seed", "calendar", "calendar_spanning", "read_staging",
           "write_table", "read_table", "star_from_testdata"]
