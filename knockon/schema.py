"""Canonical column names, alias lists and bin definitions.

Fixed values: these names, aliases, labels and edges must equal the ones the
published analysis uses, so results and file layouts line up.
"""

from __future__ import annotations

# --- fixed values: canonical raw columns -------------------------------------------------
REQUIRED_COLUMNS = [
    "TAIL_NUM", "FL_DATE", "OP_UNIQUE_CARRIER", "ORIGIN", "DEST", "CRS_DEP_TIME",
    "CRS_ARR_TIME", "DEP_DELAY", "ARR_DELAY", "DISTANCE", "CANCELLED", "DIVERTED",
]
OPTIONAL_COLUMNS = ["MONTH", "DAY_OF_WEEK", "CRS_ELAPSED_TIME", "DEP_TIME", "ARR_TIME"]

# --- fixed values: raw header aliases, first present wins -------------------------------
COLUMN_ALIASES = {
    "TAIL_NUM": ["TAIL_NUM", "Tail_Number", "TailNum"],
    "FL_DATE": ["FL_DATE", "FlightDate"],
    "OP_UNIQUE_CARRIER": ["OP_UNIQUE_CARRIER", "Reporting_Airline", "UniqueCarrier", "UNIQUE_CARRIER"],
    "ORIGIN": ["ORIGIN", "Origin"],
    "DEST": ["DEST", "Dest"],
    "CRS_DEP_TIME": ["CRS_DEP_TIME", "CRSDepTime"],
    "CRS_ARR_TIME": ["CRS_ARR_TIME", "CRSArrTime"],
    "DEP_DELAY": ["DEP_DELAY", "DepDelay"],
    "ARR_DELAY": ["ARR_DELAY", "ArrDelay"],
    "DISTANCE": ["DISTANCE", "Distance"],
    "CANCELLED": ["CANCELLED", "Cancelled"],
    "DIVERTED": ["DIVERTED", "Diverted"],
    "MONTH": ["MONTH", "Month"],
    "DAY_OF_WEEK": ["DAY_OF_WEEK", "DayOfWeek"],
    "CRS_ELAPSED_TIME": ["CRS_ELAPSED_TIME", "CRSElapsedTime"],
    "DEP_TIME": ["DEP_TIME", "DepTime"],
    "ARR_TIME": ["ARR_TIME", "ArrTime"],
}

# Columns coerced from text to numbers (bad value -> null).
NUMERIC_COLUMNS = [
    "CRS_DEP_TIME", "CRS_ARR_TIME", "DEP_DELAY", "ARR_DELAY", "DISTANCE", "CANCELLED",
    "DIVERTED", "MONTH", "DAY_OF_WEEK", "CRS_ELAPSED_TIME", "DEP_TIME", "ARR_TIME",
]

# --- fixed values: the 22-column pair table ---------------------------------------------
PAIR_COLUMNS = [
    "TAIL_NUM", "OP_UNIQUE_CARRIER", "current_FL_DATE", "current_ORIGIN", "current_DEST",
    "current_route", "current_sched_dep_hour", "current_DEP_DELAY", "current_ARR_DELAY",
    "current_DISTANCE", "prev_ORIGIN", "prev_DEST", "prev_route", "prev_ARR_DELAY",
    "prev_DEP_DELAY", "prev_DISTANCE", "prev_sched_arr_timestamp",
    "current_sched_dep_timestamp", "scheduled_turnaround_minutes", "same_airport_connection",
    "current_dep_delayed_15", "prev_arr_delayed_15",
]

# --- fixed values: the 44-column wide monthly layout kept by the download trim ----------
TRIM_COLUMNS = [
    "Year", "Month", "DayofMonth", "DayOfWeek", "FlightDate", "Reporting_Airline",
    "DOT_ID_Reporting_Airline", "Flight_Number_Reporting_Airline", "OriginAirportID",
    "OriginAirportSeqID", "OriginCityMarketID", "Origin", "OriginCityName", "OriginState",
    "DestAirportID", "DestAirportSeqID", "DestCityMarketID", "Dest", "DestCityName",
    "DestStateName", "CRSDepTime", "DepTime", "DepDelay", "TaxiOut", "WheelsOff", "WheelsOn",
    "TaxiIn", "CRSArrTime", "ArrTime", "ArrDelay", "Cancelled", "CancellationCode", "Diverted",
    "CRSElapsedTime", "ActualElapsedTime", "AirTime", "Distance", "DistanceGroup",
    "CarrierDelay", "WeatherDelay", "NASDelay", "SecurityDelay", "LateAircraftDelay",
    "TotalAddGTime",
]

# --- fixed values: bins and labels --------------------------------------------------------
# Turnaround bins: [20,45) [45,90) [90,180) [180,600]
TURNAROUND_BINS = [(20.0, 45.0, "20-44"), (45.0, 90.0, "45-89"), (90.0, 180.0, "90-179"),
                   (180.0, 600.0, "180-600")]
TURNAROUND_LABELS = ["20-44", "45-89", "90-179", "180-600"]
# Departure period by scheduled hour: 0-5, 6-11, 12-17, 18-23
DEP_PERIODS = [(0, 5, "overnight"), (6, 11, "morning"), (12, 17, "afternoon"), (18, 23, "evening")]
DEP_PERIOD_LABELS = ["overnight", "morning", "afternoon", "evening"]
# Previous-arrival delay bin edges (right-closed, first bin also left-closed)
PREV_DELAY_EDGES = [-120, -60, -30, -15, -5, 0, 5, 15, 30, 60, 120, 240, 480]

DELAY_FLAG_MINUTES = 15.0          # strict ">" for the delayed flags
TURNAROUND_MIN, TURNAROUND_MAX = 20.0, 600.0
SHOCK_THRESHOLD = 15.0
MAX_LEG = 5
MIN_MODEL_ROWS = 100
DECAY_LAMBDA_START = 0.25
DEFAULT_TAIL_PARTITIONS = 100
DEFAULT_SAMPLE_SIZE = 50_000
DEFAULT_SAMPLE_SEED = 42
HEX_GRID_SIZE = 45
