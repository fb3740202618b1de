"""Fixed values that results must agree on: vocabularies, label aliases, character sets and limits."""

# Characters trimmed from tokens (the second form keeps hyphens, the third also trims back-ticks).
TRIM = ".,;:_—- •*~#=+!?/\\()[]{}<>\"'|"
TRIM_KEEP_HYPHEN = ".,;:_— •*~#=+!?/\\()[]{}<>\"'|"
TRIM_TITLE = ".,;:_—- •*~#=+!?/\\()[]{}<>\"'`"
TRIM_POSTCODE = ".,;:_—- •*~#=+!?/\\()[]{}<>\"'|`"
ARTIFACT_ROWS = ("—", "©", "-", "- - - -", "--", "•", "~")

# The 31 fields in order.
FIELDS = (
    "File No", "Form No", "Title", "First Name", "Last Name", "Initial", "Email", "Father Name", "DOB", "Gender", "Profession",
    "Mailing Street", "City", "Postal Code", "Country", "Service Provider", "File Ref", "Reference No", "SIM No", "Network Type",
    "Mobile Model", "IMEI 1", "IMEI 2", "Plan Type", "Card Type", "Contact", "Issue Date", "Renewal Date", "Installments",
    "Amount in Words", "Remarks",
)
REQUIRED = (
    "File No", "Form No", "Title", "First Name", "Last Name", "Initial", "Email", "DOB", "Gender", "Profession", "Mailing Street",
    "City", "Postal Code", "Country", "Contact", "Issue Date", "Renewal Date", "Installments", "Amount in Words",
)
EVIDENCE = (
    "Title", "First Name", "Last Name", "Email", "DOB", "Gender", "Profession", "Mailing Street", "City", "Postal Code", "Country",
    "Mobile Model", "IMEI 1", "Contact", "Issue Date", "Renewal Date",
)
SEVERITY = {
    "MISSING_REQUIRED_FIELD": "FATAL", "INVALID_EMAIL": "FATAL", "INVALID_DOB": "FATAL", "INVALID_ISSUE_DATE": "FATAL",
    "INVALID_RENEWAL_DATE": "FATAL", "DOB_AFTER_ISSUE_DATE": "FATAL", "RENEWAL_BEFORE_ISSUE_DATE": "FATAL", "INVALID_GENDER": "FATAL",
    "INVALID_CONTACT": "FATAL", "INVALID_POSTAL_CODE": "FATAL", "INVALID_IMEI1": "FATAL", "CALCULATION_MISMATCH": "FATAL",
    "INVALID_INSTALLMENTS": "FATAL", "EMPTY_AMOUNT_WORDS": "FATAL", "MOBILE_MODEL_IMEI_CONFLICT": "FATAL", "FIELD_REGION_NOT_LOCATED": "FATAL",
    "LOW_OCR_CONFIDENCE": "REVIEW", "AMBIGUOUS_IMEI1": "REVIEW", "INVALID_INITIAL": "WARNING",
}

# Titles that open a record, and titles of the closed dictionary.
START_TITLES = (
    "mr", "mr.", "mrs", "mrs.", "ms", "ms.", "miss", "dr", "dr.", "prof", "prof.", "professor", "major", "major general", "general",
    "colonel", "col", "col.", "captain", "capt", "capt.", "lieutenant", "lt", "lt.", "commander", "cmdr", "admiral", "brigadier",
    "field marshal", "rev", "rev.", "reverend", "pastor", "father", "fr", "fr.", "rabbi", "imam", "sheikh", "sheik", "sir", "lady",
    "lord", "dame", "baron", "baroness", "judge", "justice", "hon", "hon.", "honorable", "honourable",
)
EXACT_TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof", "major general", "rev", "sir", "lady", "capt", "col", "hon")
TITLE_FORMS = {
    "mr": "Mr", "mrs": "Mrs", "ms": "Ms", "miss": "Miss", "mlss": "Miss", "dr": "Dr", "prof": "Prof", "rev": "Rev", "capt": "Capt", "col": "Col",
    "sir": "Sir", "lady": "Lady", "hon": "Hon",
}
GENDERS = {"male": "Male", "ma1e": "Male", "maie": "Male", "female": "Female", "fe-male": "Female", "femate": "Female", "fema1e": "Female"}
COUNTRIES = {
    "england": "England", "uk": "UK", "uks": "UK", "unitedkingdom": "United Kingdom", "greatbritain": "Great Britain", "ireland": "Ireland",
    "lreland": "Ireland", "scotland": "Scotland", "wales": "Wales",
}
PROVIDERS = (
    ("hutchisonwhampoa", "Hutchison Whampoa"), ("hutchison", "Hutchison Whampoa"), ("huitchisonwhampoa", "Hutchison Whampoa"),
    ("huitchison", "Hutchison Whampoa"), ("t-mobile", "T-Mobile"), ("tmobile", "T-Mobile"), ("vodafone", "Vodafone"), ("vodaf0ne", "Vodafone"),
    ("orange", "Orange"), ("virgin", "Virgin"), ("o2", "O2"), ("02", "O2"),
)
PROFESSIONS = {
    "self employed": "Self Employed", "selfemployed": "Self Employed", "self-employed": "Self Employed", "professional": "Professional",
    "services": "Services", "service": "Service", "business": "Business", "student": "Student", "others": "Others", "other": "Others",
    "fixed income": "Fixed Income", "fixedincome": "Fixed Income", "fixed incame": "Fixed Income", "unemployed": "Unemployed", "un employed": "Unemployed",
}
PLANS = (
    "turbo", "turbocall", "classic", "classicsms", "clasic", "clasicsms", "clasicplus", "classicsms+", "smspro", "sms", "sms+", "premium",
    "premiumplus", "ultra", "ultraplus", "ulira", "uliraplus", "economy", "economyplus", "alacarte", "alacartepack", "ala", "ultimate",
    "ultimateplus", "ultimata", "callplus", "call",
)
CARDS = ("master", "mastercard", "mastertitanium", "visa", "visatitanium", "visagold")
NETWORKS = {"gsm": "GSM", "cdma": "CDMA", "cdma+gsm": "CDMA+GSM", "cdma*gsm": "CDMA+GSM", "cdma+cdma": "CDMA+CDMA", "cdmagsm": "CDMA+GSM", "cdmacdma": "CDMA+CDMA"}
BRANDS = ("nokia", "siemens", "samsung", "apple", "motorola", "sony", "lg", "htc", "huawei", "blackberry", "ericsson", "alcatel", "google", "xiaomi", "oneplus")
MODEL_WORDS = ("galaxy", "iphone", "lumia", "experia", "xperia", "plus", "pro", "max")
STREETS = r"(?i)\b(Road|Street|Lane|Avenue|Drive|Way|Square|Building|House|Gardens|Crescent|Court|Walk|Close|Hill|Place|Park|Terrace|Grove|Rise|Row|Mews|Parade|Yard)\b"

# Label spellings of each field.
LABELS = {
    "IMEI 1": ("imei 1", "imei1", "imei no 1", "imei no. 1", "imei no.", "imei no", "imei-1", "imei #1", "imei number 1", "imei", "1mei 1", "1mei"),
    "IMEI 2": ("imei 2", "imei2", "imei no 2", "imei no. 2", "imei-2", "imei #2", "imei number 2", "2nd imei", "imei(2)", "imei 2:"),
    "Postal Code": ("postal code", "post code", "postcode", "postalcode", "pincode", "zip code", "zip", "post code.", "postal code.", "postcode:"),
    "Reference No": ("reference no", "reference no.", "reference number", "ref no", "ref no.", "ref #", "reference", "ref. no.", "ref number"),
    "SIM No": ("sim no", "sim no.", "sim number", "sim #", "sim", "iccid", "sim no:"),
    "Contact": ("contact", "contact no", "contact #", "telephone", "tel", "phone", "contract"),
    "Email": ("email", "e-mail", "email id", "email address", "email:", "e-mail:"),
    "DOB": ("dob", "d.o.b", "d.o.b.", "date of birth", "birth date", "dob:"),
    "Issue Date": ("issue date", "issuedate", "date of issue", "start date", "issue dt", "issue date:"),
    "Renewal Date": ("renewal date", "renewaldate", "expiry date", "exp date", "renewal dt", "renewal date:"),
    "Mobile Model": ("mobile model", "phone model", "model", "handset", "mobile model:", "handset model"),
    "Network Type": ("network type", "network", "net type", "network type:"),
    "Service Provider": ("service provider", "provider", "operator", "network provider", "service provider:"),
    "Title": ("title", "salutation", "title:"),
    "First Name": ("first name", "firstname", "forename", "given name", "first name:"),
    "Last Name": ("last name", "lastname", "surname", "family name", "last name:"),
    "Father Name": ("father name", "father's name", "father", "guardian", "father name:"),
    "Gender": ("gender", "sex", "gender:"),
    "Profession": ("profession", "occupation", "profession:"),
    "Mailing Street": ("mailing street", "street", "street address", "address line 1", "address:", "street:"),
    "City": ("city", "town", "city:"),
    "Country": ("country", "nation", "country:"),
    "Plan Type": ("plan type", "plan", "tariff plan", "plan type:"),
    "Card Type": ("card type", "card", "payment card", "card type:"),
    "File Ref": ("file ref", "file reference", "file ref:"),
}
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "bmp", "webp", "tif", "tiff")
