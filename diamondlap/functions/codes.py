"""Code sets, weights, league constants and labels.

Everything here must equal the published definitions for results to agree, so
the values stand as plain text. Operators take them as argument defaults.
"""

# --- fixed values: pitch call codes -----------------------------------------
WHIFF = ("S", "W", "T")
CALLED = ("C",)
CSW = ("S", "W", "T", "C")
SWING = ("S", "W", "T", "F", "D", "E", "X")
CONTACT = ("F", "D", "E", "X")
FOUL = ("F", "D", "E", "L")
BALL = ("B", "*B", "H")
IN_PLAY = "X"
HIT_BATTER = "M"

# --- fixed values: pitch types that are scored ------------------------------
PITCH_TYPES = ("FF", "SI", "SL", "CH", "FC", "ST", "CU", "FS", "KC")

# --- fixed values: run value of one pitch before any adjustment -------------
VALUE_WHIFF = 0.170
VALUE_CALLED = 0.025
VALUE_FOUL = 0.020
VALUE_BALL = -0.040
VALUE_HIT_BATTER = -0.150

# --- fixed values: exit-speed limits (mph) ----------------------------------
HARD_HIT = 95.0
SOFT_HIT = 85.0
BARREL_SPEED = 98.0
BARREL_ANGLE = (26, 30)

# --- fixed values: linear weights per season --------------------------------
WEIGHT_COLUMNS = (
    "weight_out", "weight_bb", "weight_hbp", "weight_single", "weight_double",
    "weight_triple", "weight_hr", "woba_scale", "league_woba",
)
LINEAR_WEIGHTS = {
    2023: (-0.098, 0.690, 0.720, 0.888, 1.271, 1.616, 2.101, 1.157, 0.317),
    2024: (-0.097, 0.688, 0.718, 0.885, 1.268, 1.612, 2.098, 1.152, 0.315),
    2025: (-0.097, 0.688, 0.718, 0.885, 1.268, 1.612, 2.098, 1.152, 0.315),
}
DEFAULT_WEIGHT_SEASON = 2024
LIVE_WEIGHT_SEASON = 2023

# Years a season can have; tables of one row per season stay within them.

# --- fixed values: batted-ball event -> (weight column, factor) -------------
EVENT_WEIGHT = {
    "single": ("weight_single", 1.0),
    "double": ("weight_double", 1.0),
    "triple": ("weight_triple", 1.0),
    "home_run": ("weight_hr", 1.0),
    "walk": ("weight_bb", 1.0),
    "hit_by_pitch": ("weight_hbp", 1.0),
    "grounded_into_double_play": ("weight_out", 2.0),
    "sac_fly": ("weight_out", 0.5),
    "sac_bunt": ("weight_out", 0.5),
}
HIT_EVENTS = ("single", "double", "triple", "home_run")

# --- fixed values: league averages used where no measurement exists ---------
LEAGUE = {
    "whiff": 0.267,
    "chase": 0.310,
    "hard_hit": 0.395,
    "csw": 0.300,
    "k": 0.227,
    "pitcher_k": 0.23,
    "tb_per_pa": 0.260,
    "barrel": 0.08,
    "woba_contact": 0.380,
    "contact": 0.78,
    "exit_velo": 88.0,
    "launch_angle": 12.0,
    "value": 0.0358,
    "finish": 20.0,
    "race_laps": 400,
}

# --- fixed values: game states ----------------------------------------------
LIVE_STATES = ("In Progress", "Manager challenge", "Delayed")
FINAL_STATES = ("Final", "Game Over")
PREVIEW_STATES = ("Preview", "Warmup", "Pre-Game", "Scheduled")

# --- fixed values: stock-car labels -----------------------------------------
SERIES_NAMES = {1: "Cup Series", 2: "Xfinity Series", 3: "Truck Series"}
FLAG_NAMES = {
    0: "none", 1: "green", 2: "yellow", 3: "red", 4: "checkered",
    8: "warm up", 9: "pre-race",
}
CHECKERED = 4
RACE_ENDPOINTS = (
    "weekend_feed", "lap_times", "pit_stops", "lap_notes", "driver_stats",
    "advanced_stats",
)
