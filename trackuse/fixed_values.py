"""Fixed values. Results are only comparable while these stay as they are."""

# Columns every location table must have.
REQUIRED_COLUMNS = (
    "individual_local_identifier",
    "X",
    "Y",
    "timestamp",
    "study_site",
    "study_name",
    "ground_speed",
    "deploy_on_timestamp",
)

# Named places used to label sites: name, latitude, longitude (EPSG:4326).
REFERENCE_POINTS = (
    ("Ebro Delta", 40.7, 0.777),
    ("Extremadura", 39.1, -5.93),
    ("Tagus Estuary", 38.9, -8.94),
    ("Doñana National Park", 37.1, -6.24),
    ("Senegal River Delta", 16.4, -16.2),
    ("Saloum Delta", 14.1, -16.6),
    ("Gambia River", 13.5, -15.8),
    ("Casamance/Coastal Guinea-Bissau", 12.6, -15.9),
    ("Lower Senegal River (West)", 16.5, -14.4),
    ("Lower Senegal River (East)", 16.2, -13.2),
    ("Inner Niger Delta (East)", 15.3, -4.52),
    ("Inner Niger Delta (West)", 16.5, -3.22),
)

# Tagging sites: name, longitude, latitude (EPSG:4326).
TAG_SITES = (
    ("Southwest Friesland", 5.60, 53.15),
    ("South Holland", 4.40, 52.05),
    ("Dümmer", 8.35, 52.52),
    ("Unterelbe", 9.20, 53.75),
    ("Extremadura", -6.30, 39.10),
    ("Tagus estuary", -9.10, 38.75),
)

# Tagging-site rules, first match wins: column, "pattern" (case-insensitive
# regular expression) or "equals", value, resulting site.
TAG_SITE_RULES = (
    ("study_name", "pattern", "South Holland", "South Holland"),
    ("study_name", "pattern", "Tagus|BtgTagus", "Tagus estuary"),
    ("study_name", "pattern", "Extremadura", "Extremadura"),
    ("study_site", "equals", "Dümmer", "Dümmer"),
    ("study_site", "equals", "Unterelbe", "Unterelbe"),
    ("study_site", "equals", "NL", "SW Friesland"),
)

# Taxa removed on import.
EXCLUDED_TAXA = ("islandica", "Limosa lapponica", "Limosa limosa islandica")

# Columns removed on import when present.
DROPPED_COLUMNS = (
    "gps_satellite_count",
    "light_level",
    "acceleration_raw_x",
    "acceleration_raw_y",
    "acceleration_raw_z",
    "gps_time_to_fix",
    "magnetic_field_raw_x",
    "magnetic_field_raw_y",
    "magnetic_field_raw_z",
    "ornitela_transmission_protocol",
    "argos_altitude",
    "argos_best_level",
    "argos_calcul_freq",
    "argos_iq",
    "argos_nb_mes",
    "argos_nb_mes_120",
    "argos_nopc",
    "argos_pass_duration",
    "argos_sensor_1",
    "argos_sensor_2",
    "argos_sensor_3",
    "argos_sensor_4",
    "argos_valid_location_algorithm",
    "argos_location_1",
    "argos_location_2",
    "height_above_ellipsoid",
    "argos_error_radius",
    "argos_gdop",
    "argos_orientation",
    "argos_semi_major",
    "argos_semi_minor",
    "gps_fix_type_raw",
    "lotek_crc_status",
    "lotek_crc_status_text",
    "manually_marked_valid",
    "icarus_timestamp_accuracy",
    "icarus_timestamp_source",
    "transmission_protocol",
    "location_accuracy_comments",
    "deployment_id_dep",
    "sensor_type_ids",
    "deploy_off_person",
    "deploy_on_person",
    "exact_date_of_birth",
    "group_id",
    "mates",
    "capture_method",
    "visible",
    "barometric_height",
    "capture_location",
    "deploy_on_location",
    "deploy_off_location",
    "individual_number_of_deployments",
    "mortality_location",
)

# Columns moved to the front on import.
LEADING_COLUMNS = (
    "individual_local_identifier",
    "X",
    "Y",
    "timestamp",
    "study_name",
)

# Country outlines that make up each regional view, and its lon/lat box.
REGIONS = {
    "iberia": ("Spain", "Portugal"),
    "west_africa": (
        "Morocco",
        "Western Sahara",
        "Algeria",
        "Mauritania",
        "Mali",
        "Niger",
        "Senegal",
        "Gambia",
        "Guinea-Bissau",
        "Guinea",
        "Sierra Leone",
        "Liberia",
        "Ivory Coast",
        "Burkina Faso",
        "Ghana",
    ),
}
REGION_BOXES = {
    "iberia": ((-9.5, 4.0), (36.0, 44.5)),
    "west_africa": ((-20.0, 0.0), (0.0, 38.0)),
}
