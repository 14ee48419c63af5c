"""Ranges, concept ids, dates and sizes that results depend on. Callers may pass their own."""

# Body measures: accepted range (index; kilograms; metres). The index flag starts at this rounded value.
BODY_BOUNDS = {"bmi": (10, 100), "weight": (5, 300), "height": (0.6, 2.43)}
OBESE_FROM = 30

# Laboratory and vital-sign measures: (column, concept ids, lowest, highest).
MEASURE_BOUNDS = (
    ("oxygen_saturation", (40762499,), 20, 100),
    ("sodium", (3019550,), 90, 200),
    ("hemoglobin", (3000963,), 3, 40),
    ("respiratory_rate", (3024171,), 5, 60),
    ("creatinine", (3016723,), 0.2, 5),
    ("urea_nitrogen", (3013682,), 3, 80),
    ("potassium", (3023103,), 1, 30),
    ("chloride", (3014576,), 60, 300),
    ("calcium", (3006906,), 3, 30),
    ("mean_corpuscular_volume", (3023599,), 50, 300),
    ("erythrocytes", (3020416,), 1, 20),
    ("mean_corpuscular_hemoglobin", (3009744,), 10, 60),
    ("systolic_pressure", (3004249,), 0, 500),
    ("diastolic_pressure", (3012888, 4154790), 0, 500),
    ("heart_rate", (3027018,), 10, 300),
    ("temperature", (3020891,), 35, 43),
    ("glucose", (3004501,), 50, 500),
    ("platelets", (3024929,), 50, 1000),
    ("hematocrit", (3023314,), 10, 150),
    ("leukocytes", (3000905,), 1, 30),
    ("bilirubin", (3024128,), 0.02, 5),
    ("albumin", (3024561,), 1, 30),
    ("troponin", (3033745,), 0, 1),
    ("procalcitonin", (44817130,), 0, 1),
)

# Role -> concept set that supplies its concepts.
MEASURE_ROLES = {
    "bmi": "body mass index",
    "weight": "Body weight (LG34372-9 and SNOMED)",
    "height": "Height (LG34373-7 + SNOMED)",
    "pcr_ag": "ATLAS SARS-CoV-2 rt-PCR and AG",
    "antibody": "Atlas #818 [N3C] CovidAntibody retry",
    "pos": "ResultPos",
    "neg": "ResultNeg",
}
MEASURE_TESTS = ("pcr_ag", "antibody")
MEASURE_RESULTS = ("pos", "neg")

# A set whose non-current members still count, for conditions only.
EXEMPT_SETS = {"condition": ("Long-COVID (PASC)",)}

# Doses: product by exposure concept and by procedure concept, excluded exposure types, codeset, first day after.
EXPOSURE_PRODUCTS = {
    702677: "pfizer",
    702678: "pfizer",
    724907: "pfizer",
    37003432: "pfizer",
    37003435: "pfizer",
    37003436: "pfizer",
    724906: "moderna",
    37003518: "moderna",
    702866: "janssen",
    739906: "janssen",
    724905: "astrazeneca",
}
PROCEDURE_PRODUCTS = {766238: "pfizer", 766239: "moderna", 766241: "janssen"}
EXCLUDED_EXPOSURE_TYPES = (38000177, 32833, 38000175, 32838, 32839)
DOSE_CODESET = 600531961
DOSES_AFTER = "2018-12-20"
DOSE_EPOCH = "2020-01-01"
FIRST_GAP_FROM = "2000-01-01"
FIRST_DOSE_PRODUCTS = ("janssen", "pfizer", "moderna")
MIN_GAP_DAYS = 5
MAX_DOSES = 4

# Windows and widths.
LOOKBACK_DAYS = 180
TOPK_WIDTH = 1000
TOPK_PAGE = 200
REFERENCE_POINTS = 128
TIME_DIMENSION = 32
SUBSET_ROWS = 10_000

# Mentions: certainty values, the placeholder concept, and the selection limits.
POSITIVE, NEGATED = "Positive", "Negated"
NO_CONCEPT = "No matching concept"
RATE_FLOOR = 0.65
MIN_MENTIONS = 200
