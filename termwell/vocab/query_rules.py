"""Rule tables of the query-understanding job.

Fixed values: expansions and signals only agree with the published behaviour
when these tables hold exactly these entries in this order.
"""

# (pattern, expansion): a phrase matches as whole words with any white space in between.
PHRASE_RULES = [
    (r"\bmbbs\s+entrance\b", "medical admissions India NEET AIIMS JIPMER undergraduate"),
    (r"\bmedical\s+entrance\b", "medical admissions NEET AIIMS JIPMER India undergraduate"),
    (r"\bbecome\s+a\s+doctor\b", "medical admissions NEET AIIMS MBBS undergraduate India"),
    (r"\bstudy\s+medicine\b", "medical admissions MBBS NEET AIIMS undergraduate"),
    (r"\bmedical\s+school\b", "medical admissions MCAT NEET USMLE MBBS"),
    (r"\bdoctor\s+entrance\b", "NEET AIIMS JIPMER medical admissions India"),
    (r"\bmedical\s+college\b", "NEET AIIMS JIPMER medical admissions India undergraduate"),
    (r"\bmed\s+school\b", "MCAT USMLE medical admissions USA"),
    (r"\bpg\s+medical\b", "NEET PG postgraduate medical India AIIMS PG"),
    (r"\bmedical\s+pg\b", "NEET PG postgraduate medical India AIIMS PG"),
    (r"\beng(?:ineering)?\s+entrance\b", "engineering admissions JEE IIT India undergraduate"),
    (r"\biit\s+entrance\b", "JEE Advanced IIT engineering admissions India"),
    (r"\bbecome\s+an?\s+engineer\b", "engineering admissions JEE GATE IIT India"),
    (r"\bcomputer\s+science\s+entrance\b", "engineering JEE GATE IIT computer science India"),
    (r"\bengg?\s+college\b", "JEE engineering admissions India IIT NIT undergraduate"),
    (r"\bmba\s+entrance\b", "MBA business admissions CAT GMAT XAT SNAP India"),
    (r"\biim\s+admission\b", "CAT IIM MBA business admissions India"),
    (r"\bbusiness\s+school\b", "MBA GMAT CAT business admissions"),
    (r"\bbecome\s+an?\s+mba\b", "MBA CAT GMAT business management India"),
    (r"\bmanagement\s+entrance\b", "CAT XAT SNAP NMAT GMAT MBA management India"),
    (r"\blaw\s+school\s+admission\b", "LSAT law school admissions USA"),
    (r"\blaw\s+entrance\b", "CLAT law India NLU undergraduate"),
    (r"\bnlu\s+entrance\b", "CLAT NLU law India undergraduate"),
    (r"\bbecome\s+a\s+lawyer\b", "CLAT LSAT law school admissions"),
    (r"\bpractice\s+law\b", "bar exam LSAT law licensing"),
    (r"\benglish\s+proficiency\b", "IELTS TOEFL PTE English language proficiency"),
    (r"\bstudy\s+abroad\b", "IELTS TOEFL GRE GMAT graduate language proficiency"),
    (r"\bwork\s+abroad\b", "IELTS TOEFL OET language proficiency"),
    (r"\bvisa\s+english\b", "IELTS TOEFL PTE language proficiency immigration"),
    (r"\bjapanese\s+language\b", "JLPT Japanese language proficiency N1 N2 N3"),
    (r"\bfrench\s+language\b", "DELF DALF French language proficiency"),
    (r"\bspanish\s+language\b", "DELE SIELE Spanish language proficiency"),
    (r"\bgerman\s+language\b", "TestDaF Goethe German language proficiency"),
    (r"\bchinese\s+language\b", "HSK Chinese language proficiency Mandarin"),
    (r"\bgovernment\s+job\b", "civil services UPSC IAS IPS government India"),
    (r"\bcivil\s+service\b", "UPSC IAS IPS civil services government India"),
    (r"\bias\s+exam\b", "UPSC civil services IAS government India"),
    (r"\bchartered\s+accountant\b", "CA ICAI accounting CPA ACCA finance"),
    (r"\bfinancial\s+analyst\b", "CFA CMA FRM finance investment"),
    (r"\bca\s+exam\b", "CA ICAI chartered accountant India accounting"),
    (r"\bforeign\s+medical\b", "FMGE USMLE PLAB AMC foreign medical graduate licensing"),
    (r"\bdoctor\s+in\s+usa\b", "USMLE ECFMG medical licensing USA"),
    (r"\bdoctor\s+in\s+uk\b", "PLAB GMC medical licensing UK"),
    (r"\bdoctor\s+in\s+australia\b", "AMC medical licensing Australia"),
    (r"\bnurse\s+license\b", "NCLEX nursing registration RN LPN"),
    (r"\bnursing\s+exam\b", "NCLEX nursing RN LPN licensing"),
    (r"\bcloud\s+certification\b", "AWS Azure GCP cloud professional certification"),
    (r"\bit\s+certification\b", "AWS CISSP CompTIA PMP professional certification"),
    (r"\bcybersecurity\s+cert\b", "CISSP CEH CompTIA Security+ cybersecurity"),
    (r"\bundergrad\s+usa\b", "SAT ACT undergraduate college admissions USA"),
    (r"\bcollege\s+usa\b", "SAT ACT undergraduate admissions USA"),
    (r"\buniversity\s+uk\b", "A-levels UCAS undergraduate admissions UK"),
    (r"\buniversity\s+australia\b", "IELTS undergraduate admissions Australia"),
    (r"\buniversity\s+abroad\b", "IELTS TOEFL SAT GRE undergraduate graduate admissions"),
    (r"\bphd\s+admission\b", "GRE graduate admissions PhD research"),
    (r"\bmasters\s+admission\b", "GRE GMAT graduate admissions masters"),
    (r"\bms\s+usa\b", "GRE graduate admissions masters USA"),
    (r"\bmasters?\s+in\s+usa\b", "GRE graduate admissions USA IELTS TOEFL"),
]

SYNONYMS = {
    "doctor": "medical NEET AIIMS MBBS medical admissions",
    "doctors": "medical NEET AIIMS MBBS medical admissions",
    "physician": "medical USMLE PLAB NEET licensing",
    "surgeon": "medical USMLE PLAB licensing",
    "dentist": "medical dental BDS dental admissions",
    "pharmacist": "pharmacy D.Pharm B.Pharm pharmaceutical",
    "nurse": "nursing NCLEX RN LPN healthcare",
    "nursing": "NCLEX RN nursing registration healthcare",
    "mbbs": "medical admissions NEET AIIMS India undergraduate",
    "medicine": "medical MBBS NEET AIIMS undergraduate",
    "engineer": "engineering JEE GATE IIT undergraduate admissions",
    "engineers": "engineering JEE GATE IIT undergraduate admissions",
    "btech": "engineering JEE IIT undergraduate India admissions",
    "iit": "JEE Advanced IIT engineering India",
    "nit": "JEE Mains NIT engineering India undergraduate",
    "mba": "MBA business management CAT GMAT XAT admissions",
    "iim": "CAT IIM MBA business India admissions",
    "management": "MBA CAT GMAT management admissions",
    "entrepreneur": "MBA business management GMAT",
    "lawyer": "law CLAT LSAT bar exam LLB admissions",
    "lawyers": "law CLAT LSAT bar exam LLB admissions",
    "advocate": "law CLAT bar exam LLB India",
    "attorney": "bar exam LSAT law USA licensing",
    "llb": "law CLAT undergraduate India admissions",
    "accountant": "CPA ACCA CA ICAI accounting finance",
    "finance": "CFA ACCA CPA FRM finance investment accounting",
    "investment": "CFA FRM finance investment",
    "banking": "CFA ACCA finance banking professional",
    "audit": "ACCA CPA CA audit accounting",
    "ca": "CA ICAI chartered accountant India accounting",
    "programmer": "software engineering JEE GATE computer science",
    "developer": "software engineering GATE computer science certification",
    "cloud": "AWS Azure GCP cloud certification professional",
    "cybersecurity": "CISSP CEH CompTIA Security+ cybersecurity",
    "devops": "AWS Azure DevOps cloud certification professional",
    "english": "IELTS TOEFL PTE OET English language proficiency",
    "japanese": "JLPT Japanese N1 N2 N3 language proficiency",
    "french": "DELF DALF French language proficiency",
    "german": "TestDaF Goethe German language proficiency",
    "spanish": "DELE SIELE Spanish language proficiency",
    "mandarin": "HSK Chinese language proficiency",
    "chinese": "HSK Chinese language Mandarin proficiency",
    "korean": "TOPIK Korean language proficiency",
    "ias": "UPSC civil services IAS government India",
    "ips": "UPSC civil services IPS government India",
    "bureaucrat": "UPSC civil services IAS government India",
    "government": "UPSC civil services government India public service",
    "usa": "USA United States GRE GMAT SAT IELTS TOEFL admissions",
    "uk": "UK United Kingdom A-levels IELTS PLAB admissions",
    "australia": "Australia IELTS AMC nursing admissions",
    "canada": "Canada IELTS MCAT LSAT admissions",
    "germany": "Germany TestDaF Goethe undergraduate graduate admissions",
    "abroad": "IELTS TOEFL GRE GMAT study international admissions",
    "language": "IELTS TOEFL PTE language proficiency test",
    "competitive": "hard very hard extremely hard competitive admissions",
    "toughest": "extremely hard very hard competitive JEE UPSC USMLE",
    "hardest": "extremely hard very hard competitive JEE UPSC USMLE",
    "easiest": "medium easy language proficiency certification",
    "free": "free no cost zero fee language proficiency certification",
    "cheap": "low cost affordable free language certification",
    "affordable": "low cost affordable certification language",
    "scholarship": "free no cost merit scholarship competitive admissions",
    "upcoming": "deadline registration closing soon",
    "certification": "professional certification AWS CFA ACCA CompTIA",
    "licensing": "licensing USMLE PLAB NCLEX FMGE bar exam professional",
    "postgraduate": "graduate admissions GRE GMAT masters PhD",
    "undergraduate": "undergraduate admissions SAT JEE NEET A-levels",
}

ACRONYMS = {
    "gre": "GRE Graduate Record Examination graduate admissions USA",
    "gmat": "GMAT Graduate Management Admission Test MBA business",
    "sat": "SAT college admissions undergraduate USA College Board",
    "act": "ACT college admissions undergraduate USA",
    "lsat": "LSAT Law School Admission Test law school USA",
    "mcat": "MCAT Medical College Admission Test medical school USA",
    "ap": "AP Advanced Placement undergraduate college USA secondary",
    "ielts": "IELTS International English Language Testing System proficiency",
    "toefl": "TOEFL Test English Foreign Language proficiency USA",
    "pte": "PTE Pearson Test English language proficiency Australia UK",
    "oet": "OET Occupational English Test healthcare professionals",
    "toeic": "TOEIC Test English International Communication workplace",
    "duolingo": "Duolingo English Test DET online language proficiency",
    "jlpt": "JLPT Japanese Language Proficiency Test N1 N2 N3 N4 N5",
    "delf": "DELF Diplôme Études Langue Française French proficiency",
    "dalf": "DALF Diplôme Approfondi Langue Française advanced French",
    "dele": "DELE Diplomas Español Lengua Extranjera Spanish proficiency",
    "siele": "SIELE Servicio Internacional Evaluación Lengua Española Spanish",
    "hsk": "HSK Hanyu Shuiping Kaoshi Chinese language proficiency Mandarin",
    "topik": "TOPIK Test Proficiency Korean language South Korea",
    "goethe": "Goethe-Zertifikat German language proficiency",
    "testdaf": "TestDaF Test Deutsch als Fremdsprache German university",
    "jee": "JEE Joint Entrance Examination engineering India IIT NIT undergraduate",
    "gate": "GATE Graduate Aptitude Test Engineering India PSU masters",
    "bitsat": "BITSAT BITS Pilani engineering India undergraduate",
    "viteee": "VITEEE VIT University engineering India undergraduate",
    "comedk": "COMEDK engineering medical Karnataka India undergraduate",
    "kcet": "KCET Karnataka Common Entrance Test engineering medical India",
    "mhtcet": "MHTCET Maharashtra engineering pharmacy India undergraduate",
    "neet": "NEET National Eligibility Entrance Test medical India undergraduate",
    "aiims": "AIIMS All India Institute Medical Sciences medical India",
    "jipmer": "JIPMER Jawaharlal Institute Postgraduate Medical Education Research India",
    "fmge": "FMGE Foreign Medical Graduates Examination India licensing",
    "cat": "CAT Common Admission Test MBA IIM business India management",
    "xat": "XAT Xavier Aptitude Test MBA India management XLRI",
    "snap": "SNAP Symbiosis National Aptitude Test MBA India Symbiosis",
    "nmat": "NMAT NMIMS Management Aptitude Test MBA India",
    "cmat": "CMAT Common Management Admission Test MBA India",
    "mat": "MAT Management Aptitude Test MBA India AIMA",
    "atma": "ATMA AIMS Test Management Admissions MBA India",
    "iift": "IIFT Indian Institute Foreign Trade MBA India international business",
    "clat": "CLAT Common Law Admission Test NLU law India undergraduate",
    "ailet": "AILET All India Law Entrance Test NLU Delhi law India",
    "upsc": "UPSC Union Public Service Commission civil services IAS IPS India government",
    "ias": "IAS Indian Administrative Service UPSC civil services India",
    "cuet": "CUET Common University Entrance Test India undergraduate central university",
    "nda": "NDA National Defence Academy India defence military",
    "usmle": "USMLE United States Medical Licensing Examination doctor USA",
    "nclex": "NCLEX National Council Licensure Examination nursing RN LPN USA",
    "comlex": "COMLEX Comprehensive Osteopathic Medical Licensing USA",
    "plab": "PLAB Professional Linguistic Assessments Board medical UK GMC licensing",
    "amc": "AMC Australian Medical Council medical licensing Australia",
    "cfa": "CFA Chartered Financial Analyst finance investment global",
    "cpa": "CPA Certified Public Accountant accounting USA",
    "acca": "ACCA Association Chartered Certified Accountants finance UK global",
    "cma": "CMA Certified Management Accountant accounting finance IMA",
    "frm": "FRM Financial Risk Manager risk finance GARP",
    "ca": "CA Chartered Accountant ICAI India accounting finance",
    "icai": "ICAI Institute Chartered Accountants India CA accounting",
    "pmp": "PMP Project Management Professional PMI certification",
    "aws": "AWS Amazon Web Services cloud certification professional",
    "cissp": "CISSP Certified Information Systems Security Professional cybersecurity",
    "ceh": "CEH Certified Ethical Hacker cybersecurity EC-Council",
    "ccna": "CCNA Cisco Certified Network Associate networking",
    "ube": "UBE Uniform Bar Exam law USA attorney licensing",
    "bar": "bar exam law licensing attorney USA UBE",
    "ib": "IB International Baccalaureate secondary school diploma",
    "gcse": "GCSE General Certificate Secondary Education UK secondary",
    "igcse": "IGCSE International General Certificate Secondary Education Cambridge",
}

# (place pattern, subject pattern, injected text); both patterns must match.
PLACE_SUBJECT_RULES = [
    (r"\bindia\b", r"\b(medical|doctor|mbbs|medicine)\b",
     "NEET AIIMS JIPMER COMEDK medical admissions India undergraduate"),
    (r"\bindia\b", r"\b(engineering|btech|iit|nit)\b",
     "JEE Advanced JEE Mains GATE IIT NIT engineering India"),
    (r"\bindia\b", r"\b(mba|management|business)\b",
     "CAT XAT SNAP NMAT IIM MBA India management"),
    (r"\bindia\b", r"\b(law|legal|lawyer)\b",
     "CLAT AILET NLU law India undergraduate"),
    (r"\bindia\b", r"\b(civil service|government|ias|ips)\b",
     "UPSC IAS IPS civil services government India"),
    (r"\busa\b|\bunited states\b", r"\b(medical|doctor|medicine)\b",
     "MCAT USMLE medical school admissions USA licensing"),
    (r"\busa\b|\bunited states\b", r"\b(law|legal|lawyer)\b",
     "LSAT bar exam law school USA attorney"),
    (r"\busa\b|\bunited states\b", r"\b(college|undergraduate|university)\b",
     "SAT ACT undergraduate college admissions USA"),
    (r"\busa\b|\bunited states\b", r"\b(graduate|masters|phd|ms)\b",
     "GRE GMAT graduate admissions USA TOEFL IELTS"),
    (r"\buk\b|\bunited kingdom\b", r"\b(medical|doctor|medicine)\b",
     "PLAB UKMLA medical licensing UK GMC"),
    (r"\buk\b|\bunited kingdom\b", r"\b(undergraduate|college|university)\b",
     "A-levels UCAS undergraduate UK"),
    (r"\baustralia\b", r"\b(medical|doctor|medicine)\b",
     "AMC medical licensing Australia"),
    (r"\baustralia\b", r"\b(nursing|nurse)\b",
     "NCLEX AHPRA nursing registration Australia"),
    (r"\bchina\b|\bchinese\b", r"\b(undergraduate|college|university)\b",
     "Gaokao undergraduate China admissions"),
    (r"\bjapan\b|\bjapanese\b", r"\b(language|study|work)\b",
     "JLPT Japanese language proficiency N1 N2 N3 N4"),
    (r"\bglobal\b|\binternational\b", r"\b(finance|investment|accounting)\b",
     "CFA ACCA CPA FRM global finance certification"),
]

# The first matching pattern names the category.
CATEGORY_RULES = [
    (r"\b(medical|mbbs|doctor|medicine|healthcare|neet|mcat|usmle|plab|amc|fmge)\b", "Medical Admissions"),
    (r"\b(mba|business|management|gmat|cat\b|xat|snap|nmat|cmat|iim)\b", "Business School"),
    (r"\b(law|legal|lsat|bar exam|attorney|llb|clat|nlu)\b", "Law School"),
    (r"\b(engineering|iit|jee|gate|btech|beng|bitsat)\b", "Engineering Admissions"),
    (r"\b(english|ielts|toefl|pte|oet|toeic|duolingo|language proficiency)\b", "Language Proficiency"),
    (r"\b(japanese|jlpt|french|delf|dalf|spanish|dele|german|testdaf|chinese|hsk|korean|topik)\b",
     "Language Proficiency"),
    (r"\b(graduate|phd|masters|gre|postgrad)\b", "Graduate Admissions"),
    (r"\b(undergraduate|bachelors|college|sat\b|act\b|a.level|gaokao|cuet)\b", "Undergraduate Admissions"),
    (r"\b(finance|cfa|cpa|acca|cma|frm|accounting|investment|ca\b|icai)\b", "Finance Certification"),
    (r"\b(civil service|government|upsc|ias|ips|public service)\b", "Government"),
    (r"\b(cloud|aws|azure|devops|cissp|ceh|ccna|pmp|certification|it\b)\b", "Professional Certification"),
    (r"\b(nursing|nclex|rn|lpn|healthcare worker)\b", "Medical Licensing"),
    (r"\b(usmle|plab|fmge|amc|medical licens)\b", "Medical Licensing"),
    (r"\b(secondary|high school|gcse|igcse|a.level|ib diploma|abitur|baccalaur)\b", "Secondary Education"),
]

# Every matching pattern names a domain, in this order.
DOMAIN_RULES = [
    (r"\b(medical|mbbs|neet|mcat|usmle|doctor|medicine|nursing|nclex)\b", "Medical"),
    (r"\b(engineering|jee|gate|iit|btech|computer science|electronics)\b", "Engineering"),
    (r"\b(mba|gmat|business|management|cat\b|xat|snap|iim)\b", "Business"),
    (r"\b(law|legal|lsat|bar exam|attorney|clat|llb)\b", "Law"),
    (r"\b(language|english|ielts|toefl|pte|oet|jlpt|french|spanish|chinese)\b", "Language"),
    (r"\b(finance|cfa|cpa|acca|accounting|investment)\b", "Finance"),
    (r"\b(civil service|government|upsc|ias|ips|public service)\b", "Government"),
    (r"\b(certification|aws|azure|cissp|cloud|it\b|devops)\b", "Professional"),
    (r"\b(secondary|a.level|abitur|baccalaur|high school|gaokao)\b", "Secondary"),
    (r"\b(undergraduate|college|sat\b|act\b|bachelors)\b", "Undergraduate"),
    (r"\b(graduate|gre|phd|masters|postgrad)\b", "Graduate"),
]
UNKNOWN_DOMAIN = "Unknown"

FREE_PATTERN = r"\b(free|no.fee|zero.cost|no.charge|without.fee|waiver)\b"
DEADLINE_PATTERN = r"\b(upcoming|soon|nearest|next|deadline|closing|due|register|apply)\b"
COST_PATTERN = r"\b(cheap|cheapest|affordable|low.cost|inexpensive|budget)\b"
DIFFICULTY_PATTERN = r"\b(hardest|toughest|most.difficult|easiest|simplest)\b"

# The first matching pattern names the sort order; "relevance" when none does.
SORT_RULES = [
    (FREE_PATTERN, "cost_asc"),
    (DEADLINE_PATTERN, "deadline"),
    (COST_PATTERN, "cost_asc"),
    (DIFFICULTY_PATTERN, "difficulty"),
]

NOISE_PATTERN = (
    r"\b(best|top|popular|famous|good|great|leading|major|important|recent"
    r"|list|all|every|what|which|how|tell|give|show|find|get|want|need)\b"
)

YEAR_PATTERN = r"\b(202[4-9]|203[0-2])\b"
MONTH_PATTERN = (
    r"\b(january|february|march|april|may|june|july|august|september|"
    r"october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)\b"
)

COUNTRIES = [
    "india", "china", "usa", "united states", "uk", "united kingdom",
    "australia", "canada", "germany", "france", "japan", "singapore",
    "brazil", "south korea", "uae", "dubai", "south africa", "nigeria",
    "kenya", "pakistan", "bangladesh", "sri lanka", "nepal", "iran",
    "indonesia", "malaysia", "philippines", "vietnam", "thailand",
    "new zealand", "ireland", "netherlands", "sweden", "switzerland",
]
