"""Schemas, column lists and fixed values of the weather model.

Values marked FIXED VALUES must equal the originating application's for the
results to match (names, thresholds, labels); they are stated as plain data.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------- columns
# Daily measures, in the order the feature table lists them.
MEASURES = ["temp_mean", "temp_max", "temp_min", "humidity",
            "precipitation", "wind_speed", "pressure"]

LAGS = [1, 3, 7]
ROLL_COLUMNS = ["temp_mean", "humidity", "pressure"]
ROLL_WINDOWS = [7, 30]
SEASONAL = ["month", "day_of_year", "sin_month", "cos_month", "sin_day", "cos_day"]
TARGET = "target_temp"

LAG_COLUMNS = [f"{c}_lag_{k}" for k in LAGS for c in MEASURES]
ROLL_MEAN_COLUMNS = [f"{c}_roll_mean_{n}" for n in ROLL_WINDOWS for c in ROLL_COLUMNS]

# Tabular model inputs: every processed column except keys and target (40).
RAW_ORDER = ["temp_max", "temp_min", "temp_mean", "humidity",
             "precipitation", "wind_speed", "pressure"]
TABULAR_FEATURES = RAW_ORDER + LAG_COLUMNS + ROLL_MEAN_COLUMNS + SEASONAL

# Sequence model inputs, in this order (11).
SEQUENCE_FEATURES = ["temp_mean", "temp_max", "temp_min", "humidity", "precipitation",
                     "wind_speed", "pressure", "sin_month", "cos_month", "sin_day", "cos_day"]

# ---------------------------------------------------------------- FIXED VALUES
# Provider field -> canonical column name.
RENAME = {
    "time": "date",
    "temperature_2m_max": "temp_max",
    "temperature_2m_min": "temp_min",
    "temperature_2m_mean": "temp_mean",
    "relative_humidity_2m_mean": "humidity",
    "precipitation_sum": "precipitation",
    "wind_speed_10m_max": "wind_speed",
    "pressure_msl_mean": "pressure",
}

# WMO weather code -> (icon, label). Any other code or null is "Unknown".
WMO_CODES = [
    (0, "☀️", "Clear sky"),
    (1, "🌤️", "Mainly clear"),
    (2, "⛅", "Partly cloudy"),
    (3, "☁️", "Overcast"),
    (45, "🌫️", "Fog"),
    (48, "🌫️", "Depositing rime fog"),
    (51, "🌧️", "Light drizzle"),
    (53, "🌧️", "Moderate drizzle"),
    (55, "🌧️", "Dense drizzle"),
    (56, "🌧️", "Light freezing drizzle"),
    (57, "🌧️", "Dense freezing drizzle"),
    (61, "🌧️", "Slight rain"),
    (63, "🌧️", "Moderate rain"),
    (65, "🌧️", "Heavy rain"),
    (66, "🌧️", "Light freezing rain"),
    (67, "🌧️", "Heavy freezing rain"),
    (71, "❄️", "Slight snow fall"),
    (73, "❄️", "Moderate snow fall"),
    (75, "❄️", "Heavy snow fall"),
    (77, "❄️", "Snow grains"),
    (80, "🌧️", "Slight rain showers"),
    (81, "🌧️", "Moderate rain showers"),
    (82, "🌧️", "Violent rain showers"),
    (85, "❄️", "Slight snow showers"),
    (86, "❄️", "Heavy snow showers"),
    (95, "⛈️", "Thunderstorm"),
    (96, "⛈️", "Thunderstorm with slight hail"),
    (99, "⛈️", "Thunderstorm with heavy hail"),
]
WMO_UNKNOWN = ("❓", "Unknown")

# Biometeorological alert cascade, first match wins (level, risk %, guideline).
ALERT_SEVERE_HEAT = ("SEVERE HEAT WARNING", 15.0,
                     "Extreme heat index detected. Combined thermal and humidity load places "
                     "significant cardiovascular strain on the body. Rest and limit physical activity.")
ALERT_HEAT = ("HEAT ADVISORY", 8.0,
              "High temperature warning. Ensure adequate hydration and avoid prolonged outdoor "
              "activity during peak sunlight hours.")
ALERT_COLD = ("COLD ADVISORY", 10.0,
              "Freezing temperatures trigger peripheral vasoconstriction, raising blood pressure "
              "and stroke vulnerability. Dress warmly and monitor vitals.")
ALERT_PRESSURE = ("BAROMETRIC PRESSURE ALERT", 5.0,
                  "Sudden drop in atmospheric pressure combined with dampness may trigger joint "
                  "inflammation and arthritis pain.")
ALERT_NORMAL = ("NORMAL", 0.0,
                "Weather conditions are within normal bounds. No environmental health warning is active.")

SEVERE_HEAT_T = 37.0          # t >= 37, or
SEVERE_HEAT_T_HUMID = 34.0    # t >= 34 and humidity >= 70
SEVERE_HEAT_HUMIDITY = 70.0
HEAT_T = 33.0                 # t >= 33
COLD_T = 10.0                 # t <= 10
PRESSURE_LOW = 1008.0         # pressure < 1008 and rain > 5
PRESSURE_RAIN = 5.0
HIGH_WIND = 20.0              # wind > 20 raises a separate caution
HUMID_AIR = 80.0              # humidity > 80: air quality Moderate, condition Humid
WET_RAIN = 5.0                # rain > 5: condition Rainy / Wet

# Current-observation defaults for missing values.
CURRENT_DEFAULTS = {"temperature_2m": 0.0, "relative_humidity_2m": 0.0,
                    "precipitation": 0.0, "pressure_msl": 1013.0, "wind_speed_10m": 0.0}
DEFAULT_UTC_OFFSET_SECONDS = 19800     # +05:30 when the payload has no offset
DEFAULT_BEST_MODEL = "Random Forest"
BASELINE_MODEL = "Random Forest"

HISTORY_DAYS = 5 * 365        # archive window length
HISTORY_DELAY_DAYS = 5        # archive lags real time by this many days
FALLBACK_ROWS = 41            # stored rows used to stand in for a live payload
FALLBACK_MIN_ROWS = 30
CONTEXT_DAYS = 14
PLOT_DAYS = 120
TOP_IMPORTANCES = 15
TRAIN_FRACTION = 0.8
DEFAULT_SEQ_LEN = 7

# ---------------------------------------------------------------- structs
RAW_DAILY = T.StructType(
    [T.StructField("location_id", T.StringType(), False),
     T.StructField("date", T.DateType(), False)]
    + [T.StructField(c, T.DoubleType(), True) for c in RAW_ORDER])

_DAILY_BLOCK_FIELDS = [T.StructField("time", T.ArrayType(T.StringType()))] + [
    T.StructField(src, T.ArrayType(T.DoubleType())) for src in list(RENAME)[1:]]

ARCHIVE_PAYLOAD = T.StructType([
    T.StructField("location_id", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("daily", T.StructType(_DAILY_BLOCK_FIELDS)),
])

HOURLY_FIELDS = [("temperature_2m", T.DoubleType()), ("relative_humidity_2m", T.DoubleType()),
                 ("precipitation_probability", T.IntegerType()), ("wind_speed_10m", T.DoubleType()),
                 ("pressure_msl", T.DoubleType()), ("weather_code", T.IntegerType())]

FORECAST_PAYLOAD = T.StructType([
    T.StructField("location_id", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("utc_offset_seconds", T.IntegerType()),
    T.StructField("current", T.StructType(
        [T.StructField(k, T.DoubleType()) for k in CURRENT_DEFAULTS])),
    T.StructField("daily", T.StructType(
        _DAILY_BLOCK_FIELDS + [T.StructField("weather_code", T.ArrayType(T.IntegerType()))])),
    T.StructField("hourly", T.StructType(
        [T.StructField("time", T.ArrayType(T.StringType()))]
        + [T.StructField(k, T.ArrayType(t)) for k, t in HOURLY_FIELDS])),
])

LOCATIONS = T.StructType([
    T.StructField("location_id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("admin1", T.StringType()), T.StructField("admin2", T.StringType()),
    T.StructField("country", T.StringType()), T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
])

# FIXED VALUES: active-location defaults when no registry row exists.
DEFAULT_LOCATION = "Mumbai, India"
DEFAULT_LAT = 19.0760
DEFAULT_LON = 72.8777

# FIXED VALUES: alert card titles and colours.
ALERT_RED = "#ef4444"
ALERT_YELLOW = "#eab308"
ALERT_GREEN = "#10b981"
WIND_CAUTION = "High Wind Caution"
ALL_CLEAR = "Atmospheric All Clear"
AIR_GOOD = "Good"
AIR_MODERATE = "Moderate"
COND_WET = "Rainy / Wet"
COND_WINDY = "Windy"
COND_HUMID = "Humid"
COND_DEFAULT = "Partly Cloudy"
