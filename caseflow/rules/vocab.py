"""Fixed values that must equal the source system's for results to match.

Everything below is data, stated in its original order. Do not reorder: the
abbreviation list is applied term after term, and the note-type list is a rank.
"""

# --- FIXED VALUES: abbreviation dictionary, applied in this order -----------------
ABBREVIATIONS: list[tuple[str, str]] = [
    ("hx", "history of"), ("#", "fracture"), ("c/o", "complaining of"), ("f/u", "follow up"),
    ("fu", "follow up"), ("w", "with"), ("ortho", "orthopaedics"), ("psych", "psychiatry"),
    ("cardio", "cardiology"), ("ophtho", "ophthalmology"), ("ENT", "otolaryngology"),
    ("plastics", "plastic surgery"), ("physio", "physiotherapy"), ("heme", "hematology"),
    ("rx", "prescription"), ("tx", "treatment"), ("d", "days ago"), ("mo", "months"),
    ("lac", "laceration"), ("@", "at"), ("hpi", "history of"), ("abx", "antibiotics"),
    ("rom", "range of motion"), ("fx", "fracture"), ("prox", "proximal"), ("wb", "weight bear"),
    ("dist", "distal"), ("min", "miniutes"), ("mins", "minutes"), ("sec", "seconds"),
    ("secs", "seconds"), ("hr", "hours"), ("hrs", "hours"), ("fb", "foreign body"),
    ("hi", "head injury"), ("approx", "approximately"), ("sw", "social worker"),
    ("sx", "symptoms"), ("sh", "self-harm"), ("pt", "patient"), ("pt's", "patient's"),
    ("r", "right"), ("rt", "right"), ("l", "left"), ("lt", "left"), ("ft", "feet"),
    ("m", "meters"), ("mm", "millimeters"), ("cm", "centimeters"),
    ("km/h", "kilometers per hour"), ("kmph", "kilometers per hour"),
    ("kph", "kilometers per hour"), ("km", "kilometers"), ("bsa", "Body Surface Area"),
    ("tbsa", "Total Body Surface Area"), ("ed", "emergency department"),
    ("pip", "proximal interphalangeal joint"), ("mt", "metatarsal"), ("hep b", "Hepatitis B"),
    ("loonie", "$1 coin"), ("toonie", "$2 coin"), ("OCD", "Obsessive-Compulsive Disorder"),
    ("ADHD", "Attention Deficit Hyperactivity Disorder"), ("BPD", "Borderline Personality Disorder"),
    ("PTSD", "Post-Traumatic Stress Disorder"), ("MDD", "Major Depressive Disorder"),
    ("GDD", "Global Developmental Delay"), ("ASD", "Autism Spectrum Disorder"),
    ("GAD", "Generalized Anxiety Disorder"), ("ODD", "Oppositional Defiant Disorder"),
    ("LD", "learning disability"), ("DMDD", "Disruptive Mood Dysregulation Disorder"),
    ("NAFLD", "Non-alcoholic Fatty Liver Disease"), ("foosh", "fall on an outstretched hand"),
    ("TMJ", "Temporomandibular Joint"), ("MCP", "metacarpophalangeal"), ("OD", "overdose"),
    ("GnRH", "Gonadotropin-Releasing Hormone"), ("trans", "transgender"),
    ("WIC", "walk-in clinic"), ("si", "suicidal ideations"),
    ("LOC", "altered level of consciousness"), ("CT", "Computed Tomography"),
    ("TTC", "Toronto Transit Commission"), ("FMD", "family medical doctor"),
    ("PCP", "primary care provider"), ("PMD", "doctor of primary medicine"),
    ("MVC", "motor vehicle collision"), ("EMS", "Emergency Medical Services"),
    ("EKG", "electrocardiogram"), ("ECG", "electrocardiogram"), ("NBNB", "non-bloody, non-bilious"),
    ("dw", "discussed with"), ("RUQ", "right upper quadrant"), ("yo", "year old"),
    ("co", "complaining of"), ("bl", "bilateral"),
]

# --- FIXED VALUES: complaints that flag a visit as a case regardless of score ------
POSITIVE_COMPLAINTS: list[str] = [
    "Oral / Esophageal Foreign Body", "Upper Extremity Injury", "Lower Extremity Injury",
    "Burn", "Anxiety / Situational Crisis", "Head Injury", "Medical Device Problem",
    "Depression / Suicidal / Deliberate Self Harm", "Paediatric Disruptive Behaviour",
    "Laceration/Puncture", "Abrasion", "Neck Trauma", "Noxious Inhalation", "Foreign Body, Nose",
    "Post-operative Complications", "Overdose Ingestion", "Bizarre Behaviour", "Cast Check",
    "Foreign Body Ear", "Major Trauma - Penetrating", "Eye Trauma", "Concern For Patient Welfare",
    "Suture / Staple Removal", "Major Trauma - Blunt", "Foreign Body, Skin", "Violent / Homicidal Behaviour",
    "Sexual Assault", "Substance Misuse / Intoxication", "Hypothermia", "Traumatic Back / Spine Injury",
    "Nasal Trauma", "Foreign Body, Eye", "Respiratory Foreign Body", "Bite", "Facial Trauma",
    "Chemical Exposure, Eye", "Genital Trauma", "Amputation", "Social Problem", "Hallucinations / Delusions",
    "Insomnia", "Ear Injury", "Chemical Exposure", "Foreign Body in Rectum", "Isolated Chest Trauma - Blunt",
    "Isolated Abdominal Trauma - Blunt", "Anal / Rectal Trauma", "Multisystem Trauma - Blunt", "Foreign Body, Vagina",
    "Body Fluid Exposure", "Ring Removal", "Multisystem Trauma - Penetrating", "Near Drowning",
    "Isolated Abdominal Trauma - Penetrating", "Isolated Chest Trauma - Penetrating", "Substance Withdrawal",
    "Electrical Injury", "Frostbite / Cold Injury", "Cardiac Arrest (Traumatic)", "Foreign Body in Eye",
]

# --- FIXED VALUES: note types merged for scoring, and the narrative order ---------
MERGE_NOTE_TYPES: list[str] = ["ED Provider Notes", "ED Triage Notes"]
NARRATIVE_NOTE_ORDER: list[str] = [
    "ED Triage Notes", "ED Provider Notes", "PS Initial Consult", "Consults",
    "Consult Follow Up", "Admission", "Discharge Summary", "Progress Notes",
    "Assessment & Plan Note", "ED Trauma Note", "ED Trauma Notes",
    "ED Procedure Note", "Procedures", "Op Note", "Transfer In / Advice Note",
]

# --- FIXED VALUES: dispositions echoed verbatim as the visit remark ----------------
REMARK_DISPOSITIONS: list[str] = [
    "admit", "deceased", "lama", "lwbr", "lwbs", "send to or", "transfer to another facility",
]

# --- FIXED VALUES: disposition groups for the disposition code ---------------------
DISP_LEFT: list[str] = ["LAMA", "LBT2", "LWBR", "LWBS"]
DISP_ADMITTED: list[str] = ["Admit", "Transfer to Another Facility", "Send to OR", "Send to Clinic"]

# --- FIXED VALUES: cutoff look-back and defaults ----------------------------------
CUTOFF_LOOKBACK_DAYS = 30
DEFAULT_SCORE_CUTOFF = 0.9
SEMANTIC_TOP_K = 5000
CUTOFF_BYPASS_ROWS = 300
CUMULATIVE_MASS = 0.95
DEID_WINDOW_WORDS = 512
CHUNK_MAX_TOKENS = 128
CHUNK_SIMILARITY = 0.5
