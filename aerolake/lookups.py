"""Fixed values the results depend on: names, thresholds, factors and texts."""

from __future__ import annotations

# Lower-case city alias -> canonical city.
CITY_ALIASES = {
    "delhi": "delhi", "new delhi": "delhi", "nct": "delhi", "delhi nct": "delhi",
    "mumbai": "mumbai", "bombay": "mumbai", "navi mumbai": "mumbai",
    "bangalore": "bengaluru", "bengaluru": "bengaluru",
    "chennai": "chennai", "madras": "chennai",
    "kolkata": "kolkata", "calcutta": "kolkata", "howrah": "kolkata",
    "hyderabad": "hyderabad", "ahmedabad": "ahmedabad", "pune": "pune", "poona": "pune",
    "surat": "surat", "jaipur": "jaipur", "lucknow": "lucknow", "kanpur": "kanpur",
    "cawnpore": "kanpur", "nagpur": "nagpur", "indore": "indore", "thane": "thane",
    "bhopal": "bhopal", "visakhapatnam": "visakhapatnam", "vizag": "visakhapatnam",
    "patna": "patna", "vadodara": "vadodara", "baroda": "vadodara", "ghaziabad": "ghaziabad",
    "ludhiana": "ludhiana", "agra": "agra", "nashik": "nashik", "nasik": "nashik",
    "faridabad": "faridabad", "meerut": "meerut", "rajkot": "rajkot",
    "kalyan-dombivli": "kalyan-dombivli", "kalyan": "kalyan-dombivli", "dombivli": "kalyan-dombivli",
    "vasai-virar": "vasai-virar", "vasai": "vasai-virar", "virar": "vasai-virar",
    "varanasi": "varanasi", "benares": "varanasi", "banaras": "varanasi",
    "srinagar": "srinagar", "aurangabad": "aurangabad", "dhanbad": "dhanbad", "amritsar": "amritsar",
    "allahabad": "prayagraj", "prayagraj": "prayagraj", "ranchi": "ranchi", "coimbatore": "coimbatore",
    "jabalpur": "jabalpur", "gwalior": "gwalior", "vijayawada": "vijayawada", "jodhpur": "jodhpur",
    "madurai": "madurai", "raipur": "raipur", "kota": "kota", "chandigarh": "chandigarh",
}

# City coordinates (latitude, longitude).
CITY_COORDINATES = {
    "delhi": (28.6139, 77.2090), "mumbai": (19.0760, 72.8777), "bengaluru": (12.9716, 77.5946),
    "chennai": (13.0827, 80.2707), "kolkata": (22.5726, 88.3639), "hyderabad": (17.3850, 78.4867),
    "ahmedabad": (23.0225, 72.5714), "pune": (18.5204, 73.8567),
}

# Display spelling used when unmapped names are kept as they are.
DISPLAY_CITY_NAMES = {
    "new delhi": "Delhi", "delhi": "Delhi", "bengaluru": "Bangalore", "bangalore": "Bangalore",
    "mumbai": "Mumbai", "chennai": "Chennai", "kolkata": "Kolkata", "hyderabad": "Hyderabad",
    "ahmedabad": "Ahmedabad", "pune": "Pune", "surat": "Surat", "jaipur": "Jaipur",
    "lucknow": "Lucknow", "kanpur": "Kanpur", "nagpur": "Nagpur", "indore": "Indore",
    "thane": "Thane", "bhopal": "Bhopal", "visakhapatnam": "Visakhapatnam", "patna": "Patna",
    "vadodara": "Vadodara", "ghaziabad": "Ghaziabad", "ludhiana": "Ludhiana", "agra": "Agra",
    "nashik": "Nashik", "faridabad": "Faridabad",
}

# AQI assumed for a city without history; any other city gets 150.
CITY_DEFAULT_LEVELS = {
    "delhi": 280, "mumbai": 160, "bengaluru": 120, "chennai": 140, "kolkata": 220, "hyderabad": 130,
    "ahmedabad": 180, "pune": 110, "surat": 150, "jaipur": 170, "lucknow": 260, "kanpur": 290,
    "nagpur": 140, "indore": 130, "thane": 150, "bhopal": 120, "visakhapatnam": 110, "patna": 240,
    "vadodara": 160, "ghaziabad": 270, "ludhiana": 190, "agra": 200, "nashik": 130, "faridabad": 250,
}
DEFAULT_CITY_LEVEL = 150.0

# Upper bounds (inclusive) of the AQI categories; above the last is Severe.
CATEGORY_BOUNDS = [(50, "Good"), (100, "Satisfactory"), (200, "Moderate"), (300, "Poor"), (400, "Very Poor")]
CATEGORIES = ["Good", "Satisfactory", "Moderate", "Poor", "Very Poor", "Severe"]
# Upper bounds of the levels used when judging forecasts.
EVALUATION_BOUNDS = [50, 100, 150, 200, 300]

# Advice per category.
HEALTH_ADVICE = {
    "Good": "Air quality is satisfactory. Enjoy your normal outdoor activities.",
    "Satisfactory": "Air quality is acceptable. Unusually sensitive people should consider reducing "
    "prolonged outdoor exertion.",
    "Moderate": "Members of sensitive groups may experience health effects. General public is less "
    "likely to be affected.",
    "Poor": "Everyone may begin to experience health effects. Members of sensitive groups may "
    "experience more serious health effects.",
    "Very Poor": "Health alert: everyone may experience more serious health effects.",
    "Severe": "Health warning of emergency conditions. The entire population is more likely to be affected.",
}
DEFAULT_ADVICE = "No data available."

# Substring of the file name -> file type, first match wins.
FILE_TYPES = [
    ("city_day", "city_daily"), ("city_hour", "city_hourly"), ("station_day", "station_daily"),
    ("station_hour", "station_hourly"), ("stations", "station_metadata"), ("aqi_data", "aqi_data"),
    ("data", "general_data"),
]

# Header variants of each internal column in reading files.
READING_HEADERS = {
    "station_id": ["station_id", "StationId"],
    "station": ["station", "Station", "site", "location"],
    "station_name": ["station_name", "StationName"],
    "city": ["city", "City"],
    "date": ["date", "Date"],
    "datetime": ["datetime", "Datetime"],
    "pm25": ["pm25", "PM2.5", "pm2.5"],
    "pm10": ["pm10", "PM10"],
    "no2": ["no2", "NO2"],
    "so2": ["so2", "SO2"],
    "co": ["co", "CO"],
    "o3": ["o3", "O3"],
    "aqi": ["aqi", "AQI"],
    "aqi_bucket": ["aqi_bucket", "AQI_Bucket"],
    "temperature": ["temperature", "Temperature"],
    "humidity": ["humidity", "Humidity"],
    "pressure": ["pressure", "Pressure"],
    "wind_speed": ["wind_speed", "Wind_Speed"],
    "state": ["state", "State"],
    "latitude": ["latitude", "Latitude"],
    "longitude": ["longitude", "Longitude"],
    "no": ["NO"], "nox": ["NOx"], "nh3": ["NH3"],
    "benzene": ["Benzene"], "toluene": ["Toluene"], "xylene": ["Xylene"],
}

# Header variants in station files.
STATION_HEADERS = {
    "station_id": ["station_id", "StationId"],
    "station": ["station", "Station"],
    "station_name": ["name", "station_name", "Site", "StationName"],
    "city": ["city", "City"],
    "state": ["state", "State"],
    "latitude": ["latitude", "Latitude"],
    "longitude": ["longitude", "Longitude"],
    "station_type": ["type", "station_type", "Station_Type"],
    "status": ["status", "Status"],
}

# Strings the CSV reader takes as missing.
NA_STRINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Keyword classes of station names and their AQI offset, first match wins.
STATION_CLASSES = [
    (["industrial", "chembur", "okhla", "bawana", "narela", "shadipur"], 30.0),
    (["traffic", "ito", "anand vihar"], 20.0),
    (["background", "green", "garden", "mandir marg", "aya nagar", "lodhi road"], -15.0),
    (["institutional", "dtu"], -10.0),
]

# Confidence points per model; any other model gets 70.
MODEL_CONFIDENCE = {
    "random_forest": 78, "xgboost": 76, "lightgbm": 76, "gradient_boosting": 74, "nf_vae": 45,
    "simple": 65, "simple_fallback": 60, "emergency_fallback": 50,
}
DEFAULT_CONFIDENCE = 70

# Metrics assumed for a model without measured ones (RMSE, MAE, R2, status).
DEFAULT_PERFORMANCE = [
    ("nf_vae", 45.2, 32.1, 0.782, "loaded"),
    ("random_forest", 48.7, 35.3, 0.745, "loaded"),
    ("gradient_boosting", 52.1, 38.7, 0.689, "loaded"),
    ("xgboost", 47.3, 33.8, 0.761, "loaded"),
    ("lightgbm", 49.1, 36.2, 0.738, "loaded"),
    ("simple", 65.3, 45.2, 0.512, "available"),
]

# Models in order of preference for automatic choice.
MODEL_PRIORITY = ["random_forest", "xgboost", "lightgbm", "gradient_boosting", "nf_vae", "simple"]

# Model descriptions.
MODEL_DESCRIPTIONS = {
    "nf_vae": "Normalizing Flow Variational Autoencoder (Primary)",
    "random_forest": "Random Forest Regressor",
    "gradient_boosting": "Gradient Boosting Regressor",
    "simple": "Simple Pattern-based Prediction",
}

# Concentration limits.
POLLUTANT_LIMITS = {"pm25": 60.0, "pm10": 100.0}

# Plausible AQI range per city.
EXPECTED_RANGES = {
    "delhi": (100.0, 400.0), "mumbai": (80.0, 200.0), "bengaluru": (60.0, 150.0),
    "chennai": (70.0, 180.0), "kolkata": (100.0, 300.0),
}

# Measure used at scoring time when a city has no reading of it.
SCORING_DEFAULTS = {
    "pm25": 100.0, "pm10": 150.0, "no2": 40.0, "so2": 15.0, "co": 1.0, "o3": 50.0, "aqi": 150.0,
    "temperature": 25.0, "humidity": 60.0, "wind_speed": 10.0, "pressure": 1013.0,
}

# Last resort when a window column has no value at all; any other column gets 0.5.
WINDOW_DEFAULTS = {
    "aqi": 150.0, "pm25": 100.0, "pm10": 100.0, "temperature": 25.0, "humidity": 60.0, "wind_speed": 10.0,
}
DEFAULT_WINDOW_VALUE = 0.5

# Five-point provider index -> AQI; anything else gets 150.
PROVIDER_SCALE = {1: 50.0, 2: 100.0, 3: 150.0, 4: 200.0, 5: 300.0}
DEFAULT_PROVIDER_AQI = 150.0

# Candidate model inputs, in order.
CORE_FEATURES = [
    "pm25", "pm10", "no2", "so2", "co", "o3", "year", "month_sin", "month_cos", "dayofweek_sin",
    "dayofweek_cos", "dayofyear_sin", "dayofyear_cos", "city_encoded",
]
ADDITIONAL_FEATURES = [
    "temperature", "humidity", "pressure", "wind_speed", "no", "nox", "nh3", "benzene", "toluene", "xylene",
]
RELIABLE_SHARE = 0.3
