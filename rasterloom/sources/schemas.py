"""Declared schemas of the source tables; nothing is inferred."""

# Column names and kinds of the external files, file patterns of the polygon catalogue's variants.
QUALITY = "ref_id BIGINT, q1 DOUBLE, q2 DOUBLE, q3 DOUBLE, q4 DOUBLE, obs_id STRING"
GEOMETRY = "ref_id BIGINT, obs_id STRING, ang_in DOUBLE, ang_em DOUBLE, ang_ph DOUBLE, lat_center DOUBLE, lon_center DOUBLE, width DOUBLE, length DOUBLE, surface DOUBLE"
SHAPES = "ref_id BIGINT, foot_geom STRING, point_geom STRING"
SPECTRA = "ref_id BIGINT, id STRING, obs_id STRING, waves STRING, photom_iof STRING"
TERRAIN = "ref_id BIGINT, lrm INT, sm_plain INT, `430_1000` DOUBLE"
GROUPS = ("Group_id", "Central_long", "Central_lat")
DISKS = {"Central.Longitude.dec.degrees": "lon", "Central.Latitude.dec.degrees": "lat", "Geodesic.area.km.2": "area"}
CALIBRATION = ("centre_nm", "fwhm_nm", "slope", "offset", "resid_std", "resid_corr_mean")
SPLITS = "ref_id BIGINT, split STRING"
LAYER = "row INT, col INT, g FLOAT, c0 FLOAT, c1 FLOAT"
PIXELS = "row INT, col INT, bands ARRAY<FLOAT>"
CATALOGUE_SEPS = (";", ",", "\t")
WKT_KINDS = ("POLYGON", "MULTIPOLYGON")
VARIANTS = {"0.7": "*hollows_07*.csv", "0.8": "*hollows_08*.csv"}
