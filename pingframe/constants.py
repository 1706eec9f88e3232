"""Fixed domain values: class lists, rule tables and default parameters.

Everything here is a value the results depend on, not logic.  The tables are
configuration-sized (tens of rows), so operators may turn them into literal
maps or tiny DataFrames without any size check.
"""

# ---- class taxonomy (fixed values; list position is the class id) ----------
CLASS_NAMES = [
    "ghost_net", "wreck", "aircraft", "pipeline", "cylinder_drum", "tire",
    "container", "human_body", "mine_like", "rock_cluster", "sand_ripple", "reef",
]
NATURAL_CLASSES = ["rock_cluster", "sand_ripple", "reef"]
ANOMALY_CLASS = "unknown_anomaly"
REPORTABLE = [c for c in CLASS_NAMES if c not in NATURAL_CLASSES] + [ANOMALY_CLASS]
CLASS_IDS = {name: i for i, name in enumerate(CLASS_NAMES)}
WRECK_LIKE = ["wreck", "aircraft"]

# ---- words people use for a class (fixed values) ----------------------------
CLASS_SYNONYMS = {
    "ghost net": "ghost_net", "ghostnet": "ghost_net", "net": "ghost_net",
    "wreck": "wreck", "shipwreck": "wreck", "ship": "wreck",
    "aircraft": "aircraft", "plane": "aircraft",
    "pipeline": "pipeline", "pipe": "pipeline",
    "drum": "cylinder_drum", "cylinder": "cylinder_drum", "barrel": "cylinder_drum",
    "tire": "tire", "tyre": "tire", "container": "container",
    "body": "human_body", "victim": "human_body", "mine": "mine_like",
}
SEVERITY_WORDS = {"critical": 75.0, "severe": 75.0, "high": 50.0, "medium": 25.0}

# ---- severity (fixed values) -------------------------------------------------
HAZARD = {
    "ghost_net": 1.0, "human_body": 1.0, "mine_like": 0.95, "container": 0.8,
    "cylinder_drum": 0.75, "wreck": 0.6, "aircraft": 0.6, "pipeline": 0.5,
    "tire": 0.3, "unknown_anomaly": 0.65,
}
SEVERITY_WEIGHTS = {"hazard": 0.4, "size": 0.15, "height": 0.1, "depth": 0.15, "proximity": 0.2}
SEVERITY_BANDS = [
    (75.0, "critical", "ff3b30"), (50.0, "high", "ff9500"),
    (25.0, "medium", "ffcc00"), (0.0, "low", "34c759"),
]
PRIORITY_BY_BAND = {"critical": "HIGH", "high": "MEDIUM", "medium": "LOW", "low": "LOW"}
HIGH_CONFIDENCE_PCT = 70.0

# ---- height bands per class, metres, and scoring (fixed values) --------------
HEIGHT_BANDS = {
    "ghost_net": (0.0, 2.5), "wreck": (0.5, 15.0), "aircraft": (0.5, 8.0),
    "pipeline": (0.1, 1.5), "cylinder_drum": (0.2, 1.5), "tire": (0.0, 1.2),
    "container": (1.0, 3.0), "human_body": (0.0, 0.6), "mine_like": (0.2, 1.2),
    "rock_cluster": (0.0, 5.0), "sand_ripple": (0.0, 0.6), "reef": (0.0, 10.0),
}
SCORING = {
    "temperature": 1.05, "violation": 0.40, "no_highlight": 0.50, "no_shadow": 0.75,
    "both_cues": 1.15, "verifier_floor": 0.4, "verifier_gain": 0.8,
    "verifier_lo": 0.4, "verifier_hi": 1.2, "min_pings": 3, "thin": 0.6,
}
SHADOW = {
    "shadow_thresh": 0.5, "min_dark_frac": 0.6, "highlight_min_ratio": 1.4,
    "max_height_m": 20.0, "bg_width": 40, "bg_gap": 4, "tolerance": 2,
    "lead_in": 4, "core_frac": 0.6,
}

# ---- feature order of the verifier (fixed values) ----------------------------
FEATURE_NAMES = [
    "highlight_ratio", "shadow_ratio", "shadow_len_m", "height_m", "has_height",
    "shadow_linearity", "contour_regularity", "texture_entropy_delta",
    "ping_persistence", "aspect_ratio", "area_px", "range_frac", "score_raw",
]

# ---- sonar geometry (fixed values) -------------------------------------------
SONAR = {
    "beam_deg": 0.5, "pulse_s": 1.0e-4, "sv_mps": 1500.0,
    "sv_uncertainty": 0.01, "multipath_tolerance": 0.15,
}
KNOTS_TO_MPS = 0.514444
FEET_TO_M = 0.3048
NAV_UNCERTAINTY_M = 2.0
LAYBACK_UNCERTAINTY_M = 5.0

# ---- operator instructions (fixed values, wording included) ------------------
ACTION_THRESHOLDS = {"zone_radius_m": 500.0, "high_severity_at": 75.0, "deep_m": 40.0, "shallow_m": 10.0}
ZONE_AUTHORITIES = {
    "mpa": "the marine protected area authority",
    "turtle_zone": "the Wildlife Warden",
    "shipping_lane": "the Directorate General of Shipping",
}
DEFAULT_AUTHORITY = "the relevant authority"
# class, base, near_sensitive_zone, high_severity, deep, shallow, always_override, requires
ACTION_RULES = [
    ("ghost_net", "Entanglement hazard - flag for ROV recovery with cutting tools",
     "Entanglement hazard in protected habitat - notify {zone_authority} before recovery",
     "URGENT: active entanglement risk - prioritise for immediate recovery",
     "Entanglement hazard beyond diver depth - ROV recovery required", None, False, "recover"),
    ("human_body", "Notify SAR authority and local police immediately. Do not disturb.",
     None, None, None, None, True, "recover"),
    ("mine_like", "Do NOT approach - notify naval EOD. Record position and clear the area.",
     None, None, None, None, True, "recover"),
    ("container", "Assess contents before recovery - possible hazardous cargo",
     "Possible hazardous cargo near protected habitat - notify {zone_authority}", None, None,
     "Navigational hazard in shallow water - notify the Directorate General of Shipping", False, "recover"),
    ("cylinder_drum", "Possible chemical container - sample before recovery",
     "Possible chemical container near protected habitat - notify {zone_authority}",
     None, None, None, False, "recover"),
    ("pipeline", "Verify against cable/pipeline charts before any intervention",
     None, None, None, None, False, "recover"),
    ("wreck", "Survey-only - check heritage status before any disturbance", None, None, None,
     "Navigational hazard in shallow water - notify the Directorate General of Shipping", False, "recover"),
    ("aircraft", "Notify DGCA and naval authorities - do not disturb", None, None, None, None, True, "recover"),
    ("tire", "Low priority - batch with other recoveries in the same zone", None, None, None, None, False, "recover"),
    ("unknown_anomaly", "Unclassified - recommend resurvey or ROV visual inspection",
     None, None, None, None, False, "review"),
]
ACTION_COLUMNS = ["cls", "base", "near_zone", "high_severity", "deep", "shallow", "always_override", "requires"]

# ---- annotation class names -> ours; None drops the box (fixed values) -------
ANNOTATION_CLASSES = {
    "tyre": "tire", "human body": "human_body", "plane": "aircraft",
    "cylinder": "cylinder_drum", "metal bucket": "cylinder_drum", "cube": "container",
    "ball": "mine_like", "circle cage": "ghost_net", "square cage": "ghost_net", "rov": None,
}
SPLIT_WORDS = [("training", "train"), ("test_1", "val")]
HOLDOUT_WORD = "test_2"

# ---- sentences of the physics gate (fixed values) ----------------------------
REASONS = {
    "no_highlight": "no acoustic highlight above local seabed",
    "no_height": "no measurable shadow: height unverified",
    "outside": "height %.2f m outside %s %s",
    "band": "band [{}, {}] m",
    "thin": "thin return (%d < %d pings): likely impulsive noise",
}

# ---- scales of the severity terms, and their values where nothing was measured (fixed values) --
SEVERITY_SCALES = {"area_m2": 40.0, "height_m": 2.0, "shallow_m": 20.0, "deep_m": 100.0, "deep": 0.2, "no_height": 0.3, "no_depth": 0.5}
