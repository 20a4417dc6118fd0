"""Rule tables. Results depend on these exact strings and numbers; replace them for another corpus."""

from __future__ import annotations

# Thresholds of the layout stage (confidences, letters, pixels at 360 dpi, fractions).
CONF_DROP, CONF_LETTERS, STUB_LETTERS, STUB_WIDTH, IMG_CONF, IMG_LETTERS = 0.55, 12, 4, 0.35, 0.85, 6
FOOTNOTE_KEEP_LETTERS, WORD_DROP_CONF, COL_MIN_WIDTH, COL_MAX_LINES, COL_MIN_GAP = 3, 0.40, 0.60, 4, 120
BODY_MIN_WORD_H, BODY_PITCH_FRAC, BODY_MIN_WORDS, BODY_PITCH_WORDS = 35, 0.85, 5, 8
MARKER_MIN_CONF, MARKER_MIN_REGION_LINES, TITLE_CENTER, CROP_PAD = 0.45, 3, 0.03, 12

CITATION_KEEP = r"^[\(\[]?[\dIVXLC/,.\s–—-]*\b(?:S|Bd|Nr|Fol|Abb|Taf|Anm|Cap|Fasz)\."
FOOTNOTE_KEEP = r"^\d{1,2}[ .]\S"
DATE_KEEP = r"^(?:Um|Von|Nach|Vor|Ende|Anfang|Mitte)?\s*\d{3,4}(?:\s*[/-]\s*\d{1,4})?\.?$"
WORD_DROP = r"^[.,;:|_]{1,2}$"
ENTRY = r"^(\d{1,2}) "
CAPTION_OPEN = r"^Abb\."
SIGNATURE = r"^\d{1,3} - Kunstdenkmäler\b"
FOLIO = r"\b(\d{2,4})\b"
ENUMERATOR = r"^[a-z]\)[.,;:]?$"
MARKER_STRONG = "‘’‚'*®°!|}]"
HYPHEN_STRIP = ".,;:()«»\"'’‘‚*®°!?|}][-⁰¹²³⁴⁵⁶⁷⁸⁹"
ROMAN = r"^M{0,4}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})$"

# Misread glyphs: (pattern, replacement), applied in this order.
GLYPHS = [
    (r"^ı(?=[ .,])", "1"),
    (r"(?<=[ (])ı(?=[.,)] )", "1"),
    (r"(?<=\d)ı\b", "1"),
    (r"ı(?=\d)", "1"),
    (r"\bıo0\b", "100"),
    (r"(?<=\bFol\. )ı(?=\d)", "1"),
    (r"(?<=\bNr\. )ı\b", "1"),
    (r"(?<=\bH\. )ı(?=\d)", "1"),
    (r"\bS\.go\b", "S.90"),
    (r"\bBd\.g\b", "Bd.9"),
    (r"\bTab\.\s*1I\b", "Tab. II"),
    (r"\bBerung\b", "ßerung"),
    (r"([,(]\s*)5\.(\s*\d)", "$1S.$2"),
    (r"\b[Tt] (?=1[6-9]\d\d\b)", "† "),
    (r"\((?:T|t) (1[6-9]\d\d)\)", "(† $1)"),
    (r"(?<=\d) X (?=\d)", " × "),
    (r"\b1’Iconographie\b", "l’Iconographie"),
    (r"\bSign\. IT,", "Sign. II,"),
    (r"(?<=\d) \.(?=[a-z])", " "),
    (r"\bE, (?=[A-Z]{2,})", "E. "),
    (r"\bSiche\b", "Siehe"),
    (r"\bAbb\. (\d):(\d\d)\b", "Abb. $1$2"),
    (r"\bZISKG\b", "ZfSKG"),
]

# Misread names of one volume and their readings.
GAZETTEER = {
    "Dıck": "DICK", "DıcK": "DICK", "Dick": "DICK", "AnTonı": "ANTONI", "ANTonı": "ANTONI", "ANnToNnI": "ANTONI", "ANnTonI": "ANTONI",
    "AnTonI": "ANTONI", "DüÜrrs": "DÜRRS", "Rırrmeyer": "RITTMEYER", "Rıtt": "RITT", "Rırrt": "RITT", "Dumzısen": "DUMEISEN",
    "Dumeısens": "DUMEISENS", "Carı": "CARL", "Gysı": "GYSI", "JoacHım": "JOACHIM", "Icnaz": "IGNAZ", "IGNn": "IGN", "Künsrtie": "KÜNSTLE",
    "ZEcKEL": "ZECKEL", "PoEsCHEL": "POESCHEL", "PAuL": "PAUL", "FRAnz": "FRANZ", "ERwInN": "ERWIN", "BENnz": "BENZ", "AnT": "ANT",
    "MicHAEL": "MICHAEL", "TuEgopDosius": "THEODOSIUS", "NAEr": "NAEF", "Knonavu": "KNONAU", "MOSBRUGGER": "MOOSBRUGGER", "I1I": "III",
    "IlI": "III", "Nörzuıı": "NÖTZLI", "LurTz": "LUTZ", "TH1EME-BECKER": "THIEME-BECKER", "THJEME-BEcKEr": "THIEME-BECKER",
    "TH1EME": "THIEME", "Joy": "JOH", "Jon": "JOH", "JoH": "JOH",
}
HYPHEN_JOIN = [("RITT", "MEYER")]
HYPHEN_COMPOUND = [("St", "Thecla-Altar"), ("THIEME", "BECKER")]
CAPS_KEEP = ["UB", "SKL", "HBLS", "MAGZ", "SLM", "ZAK", "CS"]
CAPS_LOWER = "DER DIE DAS DES DEM DEN UND ODER ALS IN IM AN AM AUF AUS BEI FÜR MIT NACH VON VOM VOR ZU ZUM ZUR ÜBER".split()

# Footnote residue in running text, deleted in this order.
RESIDUE = [r"(?<=[\wäöüÄÖÜß»)])\*", r"\s?[!?*]+(?=[.,])", r"(?<=[a-zäöüß])\?(?=\s[a-zäöüß])", "[¹²³⁴⁵⁶⁷⁸⁹⁰]+", r"(?<=[\wäöüß])[‘'`°](?=[.,])"]
# Periods that end no sentence.
MONTHS = "(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)"
PROTECT = [
    r"\b(Abb|Nrn|Nr|Joh|hl|St|Vad|Bd|vgl|ca|sog|ev|kath|Jh|bzw|Taf|Diss|Mitt|ff|f)\.",
    r"(?<=[\s(«—-])([A-Z])\.(?=\s?[A-ZÄÖÜ\d«])",
    rf"\b(\d{{1,2}})\.(?=\s{MONTHS})",
    r"\b([IVX]{2,})\.(?=\s[a-zäöü])",
]
GUARD = "\ue000"
FOOTNOTE_LINE = r"^[\s_\-\*\=—–]{4,}$|^\s*[¹²³⁰-⁹]"
FOOTNOTE_ENTRY = r"^\s*(\d{1,3}[\.]\)\s|\[\d{1,3}\]\s|[¹²³⁴⁵⁶⁷⁸⁹⁰]\s|\*+\s)"

# Words that a relaxed comparison drops from the front, and quotes around a name.
LEADING = "der die das den dem des ein eine einer eines einem einen im in an am auf von zu zur zum vom".split()
QUOTES = "\"'„“”»«"

# Entity categories in order: (category, type, label).
CATEGORIES = [
    ("persons", "person", "PER"), ("places", "place", "PLACE"), ("physical_human_made_thing", "physical_human_made_thing", "OBJ"),
    ("visual_item", "visual_item", "VIS"), ("iconographic_subject", "iconographic_subject", "ICO"), ("dates", "date", "DATE"), ("groups", "group", "GROUP"),
]

P, G, L, O, V, I, D = "person", "group", "place", "physical_human_made_thing", "visual_item", "iconographic_subject", "date"
_SHOWN = "shows_visual_item_elements shows_motif_units element_is_shown_in_works"
_SCENES = "shows_scenes scene_is_shown_in_works"
# Relations: (type, subject types, object types, property, names in the database, {object type: other names}).
RELATIONS = [
    ("created", [P, G], [O, L, V], "P94", "has_designer created_work created_works was_produced_by_person", {L: "is_designer_of_building has_designer"}),
    ("attributed_to", [O, V], [P], "P141", "", {}),
    ("has_geographic_epithet", [P], [L], None, "", {}),
    ("has_patron", [O, L], [P, G], None, "", {}),
    ("happened_in_date", [O, L, P], [D], "P4", "", {}),
    ("has_lifespan", [P], [D], "P4", "", {}),
    ("was_restored_in", [O, L], [D], "P31", "interventions", {}),
    ("has_current_location", [O, V], [L], "P55",
     "has_current_location_building has_current_location_buildings has_current_location_city has_current_location_country has_current_location_region "
     "is_current_location_of_buildings is_current_location_of_city is_current_location_of_collection is_current_location_of_groups "
     "is_current_location_of_region is_current_location_of_work", {}),
    ("has_original_location", [O, V], [L], "P53",
     "has_former_location_building has_former_location_buildings is_former_location_of_collection is_former_location_of_groups is_former_location_of_work", {}),
    ("worked_in", [P, G], [L], None, "has_production_location_cities has_production_location_regions", {}),
    ("born_in", [P], [L], "P7", "has_place_of_birth is_place_of_birth_of", {}),
    ("died_in", [P], [L], "P7", "", {}),
    ("influenced_by", [P, O, L], [P, O, V], "P15", "", {}),
    ("collaborated_with", [P, G], [P, G], None, "", {}),
    ("married_to", [P], [P], None, "", {}),
    ("student_of", [P], [P], None, "", {}),
    ("teacher_of", [P], [P], None, "", {}),
    ("owned_by", [O], [P, G], "P52",
     "has_current_owner_person is_current_owner_of_building is_current_owner_of_buildings is_current_owner_of_collection "
     "is_current_owner_of_collections is_current_owner_of_work is_current_owner_of_works", {}),
    ("depicts", [O, V], [V, I], "P62", _SHOWN, {I: _SCENES}),
    ("decorated_with", [O, L], [V, I], "P56", _SHOWN, {I: _SCENES}),
    ("carries_inscription", [O, L], [V], "P128", "carries_inscriptions has_inscription_types", {}),
    ("part_of", [O, L], [O, L], "P46", "consists_of is_part_of_collection", {}),
]

# Tag aliases of token-tagged corpora; anything else is upper-cased.
TAG_ALIASES = {
    "pers": "PER", "per": "PER", "loc": "LOC", "org": "ORG", "prod": "PROD", "time": "TIME", "date": "DATE", "work": "WORK", "object": "OBJECT",
    "scope": "SCOPE", "humanprod": "HUMANPROD", "building": "BUILDING", "street": "STREET",
}
LANGUAGES = {"German": "deu", "English": "eng", "French": "fra", "Italian": "ita"}
# Audit kinds in the order of the report.
KINDS = ["noise", "column split", "stray word", "rule", "name", "footnotes", "marker", "  candidate", "  ignored", "hyphen", "  hyphen open", "caps"]
