"""Fixed values of the domain. Results depend on them, so they are stated as they are."""

from pyspark.sql import DataFrame, SparkSession

from weekwise.operators.score import Rule

# Entities with code, parent and population.
ENTITIES = (
    ("tenerife", "tfe", "sc_tenerife", 916_000),
    ("la_palma", "lpa", "sc_tenerife", 83_000),
    ("gomera", "gom", "sc_tenerife", 22_000),
    ("hierro", "hie", "sc_tenerife", 11_000),
    ("gran_canaria", "gcan", "las_palmas", 852_000),
    ("lanzarote", "lzt", "las_palmas", 152_000),
    ("fuerteventura", "ftv", "las_palmas", 119_000),
)

# Weather stations to fall back on, in order of preference.
FALLBACK_STATIONS = {
    "tenerife": ("C429I", "C449C", "C449I", "C449X", "C449Z", "C449E", "C449H"),
    "gran_canaria": ("C649I", "C649O", "C649X", "C649Z"),
    "lanzarote": ("C029O", "C829C", "C829I", "C829X"),
    "fuerteventura": ("C249I", "C829F", "C829H", "C829Z"),
    "la_palma": ("C139E", "C229O", "C229I", "C229X", "C229Z"),
    "gomera": ("C329B", "C329Z", "C449O", "C329I", "C329X"),
    "hierro": ("C929I", "C939E", "C939A", "C939B"),
}

# Words that mark a dust or heat warning.
EVENT_KEYWORDS = {
    "is_dust_event": (
        "polvo en suspensión", "polvo en suspension", "calima", "intrusión sahar", "intrusion sahar",
        "intrusión sahariana", "intrusion sahariana", "sahar", "dust",
    ),
    "is_heat_event": (
        "altas temperaturas", "temperaturas máximas", "temperaturas maximas", "temperatura máxima",
        "temperatura maxima", "ola de calor", "heat warning", "high temperature",
    ),
}

# Narrower event patterns that decide the weekly classes.
EVENT_PATTERNS = {
    "is_dust_event": "(dust|polvo)",
    "is_heat_event": "(temper|high-temperature|calor)",
}

# Place names per entity. "santa cruz" alone is ambiguous between two entities; rows that
# name "santa cruz de la palma" are told apart in ``feeds.classify_alerts``.
AREA_KEYWORDS = {
    "tenerife": ("tenerife", "tfe", "santa cruz", "sta cruz", "la laguna", "candelaria", "arona", "granadilla"),
    "gran_canaria": ("gran canaria", "las palmas", "telde", "gáldar", "galdar", "aguimes", "agüimes"),
    "lanzarote": ("lanzarote", "arrecife", "teguise", "tinajo", "yaiza", "tías", "tias"),
    "fuerteventura": ("fuerteventura", "puerto del rosario", "pájara", "pajara", "antigua", "tuineje"),
    "la_palma": ("la palma", "santa cruz de la palma", "los llanos", "breña", "brena", "tazacorte"),
    "la_gomera": ("la gomera", "san sebastián", "san sebastian", "valle gran rey", "hermigua"),
    "el_hierro": ("el hierro", "hierro", "valverde", "frontera", "el pinar"),
}

# Areas of alerts whose name is not the id of their entity.
AREA_ENTITY = {"la_gomera": "gomera", "el_hierro": "hierro"}

# Spellings of the entities.
ENTITY_ALIASES = {
    "tenerife": ("tfe", "tenerife"),
    "gran_canaria": ("gcan", "gran canaria"),
    "lanzarote": ("lzt", "lanzarote"),
    "fuerteventura": ("ftv", "fuerteventura"),
    "la_palma": ("lpa", "la palma", "palma", "palma, la"),
    "gomera": ("gom", "gomera", "la gomera", "gomera, la"),
    "hierro": ("hie", "hierro", "el hierro", "hierro, el"),
}

# Rules of the current score; the weights sum to 4.
SCORE_RULES = (
    Rule("PM10", ">=", 50, 1.0),
    Rule("PM10", ">=", 100, 1.0),
    Rule("PM2.5", ">=", 20, 0.75),
    Rule("low_vis_confirmed_any_week", ">", 0, 0.5),
    Rule("humidity_mean", "<=", 60, 0.25),
    Rule("tmax_anomaly", ">", 0.5, 0.5),
)

# Rules and cuts of the percentile score.
PERCENTILE_RULES = (
    Rule("PM10", ">=", quantile=0.90),
    Rule("PM10", ">=", quantile=0.95),
    Rule("humidity_mean", "<=", quantile=0.25),
    Rule("low_vis_any_week", ">=", 1),
    Rule("pressure_hpa_mean", ">=", quantile=0.75, weight=0.5),
)
PERCENTILE_CUTS = (1, 2, 3)

# Physical bounds of weekly weather.
WEATHER_RANGES = {
    "temp_c_mean": (-50.0, 60.0),
    "pressure_hpa_mean": (900.0, 1050.0),
    "wind_ms_mean": (0.0, 40.0),
    "gust_max": (0.0, 80.0),
    "humidity_mean": (0.0, 100.0),
    "prec_sum": (0.0, None),
}


def entity_table(spark: SparkSession) -> DataFrame:
    """``entity, code, parent, population``."""
    return spark.createDataFrame(list(ENTITIES), "entity string, code string, parent string, population long")


def alias_table(spark: SparkSession) -> DataFrame:
    """``alias, canonical``."""
    rows = [(alias, name) for name, aliases in ENTITY_ALIASES.items() for alias in aliases]
    return spark.createDataFrame(rows, "alias string, canonical string")
