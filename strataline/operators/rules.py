"""Fixed values of the eligibility rules: patterns and phrases, as the rules have to read them.

Patterns are meant without regard to case and with Unicode's letters and
blanks (see positions.flags), unless it says otherwise.  Each table is in the
order in which its rows are looked at.
"""

#: What makes a title another trade.
OTHER_TRADES = (
    r"\bfactory\b", r"\bmanufacturing\b", r"\bfacilities\b", r"\bfacility\b", r"\bdata\s?cent(?:er|re)\b", r"\bmechanical\b", r"\belectrical\b", r"\bcivil\b",
    r"\bchemical\b", r"\bindustrial\b", r"\bprocess\s+engineer\b", r"\bfield\s+engineer\b", r"\bsales\s+engineer\b", r"\bsolutions?\s+architect\b",
    r"\bcustomer\s+engineer\b", r"\bsupport\s+engineer\b", r"\bsolutions?\s+engineer\b", r"\bit\s+(?:engineer|support|administrator)\b",
    r"\bsystems?\s+admin(?:istrator)?\b", r"\b(?:data engineer(?:ing)?|analytics)[\s/&-]+support\s*$",
    r"\b(?:data science|software|programming)\s+(?:coach|instructor|tutor)\b", r"^\s*(?:technical\s+)?product\s+owner\b", r"\bdata engineer(?:ing)?\s+analyst\b",
    r"\bnetwork\s+operations\b", r"\bhelp\s?desk\b", r"\bdesktop\b", r"\bhardware\s+engineer\b", r"\bpackaging\b", r"\bsupply\s+chain\s+engineer\b", r"\bhvac\b",
    r"\btest\s+(?:job|posting|requisition)\b", r"\bvalue\s+engineer\b", r"\bsupplier\s+quality\b",
)

#: Titles of the role families, in the order in which they are looked at.
FORWARD_DEPLOYED = (
    r"\bforward deployed engineer\b", r"\bforward-deployed engineer\b", r"\bforward deployed software engineer\b", r"\bforward-deployed software engineer\b",
    r"\bforward deployed ai engineer\b",
)
COMPILERS = (
    r"\bcompilers?\b", r"\bcompilation\b",
)
RUNTIMES = (
    r"\bruntimes?\b", r"\brun[- ]time (?:systems?|software|engineer|developer)\b",
)
TESTING = (
    r"\b(?:qa|sdet|quality assurance|test automation|automation testing)\b", r"\bquality automation\b", r"\btest(?:ing)?\s+(?:and|&)\s+(?:software|analytics)\b",
    r"\b(?:software )?test(?:ing)? engineer(?:ing)?\b", r"\bsoftware (?:development )?engineer(?:ing)? in test\b",
    r"\bsoftware (?:dev(?:elopment)? )?engineer(?:ing)?(?:\s+(?:[ivx]+|\d+))?\s*[-,:/]\s*test\b", r"\bsoftware quality engineer(?:ing)?\b",
)
MACHINE_LEARNING = (
    r"\bai engineer\b", r"\bartificial intelligence engineer\b", r"\bmachine learning engineer\b", r"\bsoftware mach(?:ine)?\.? learn(?:ing)?\.? engr\b",
    r"\bml engineer\b", r"\bai/ml engineer\b", r"\bml/ai engineer\b", r"\bapplied ai engineer\b", r"\bapplied ml engineer\b", r"\bgenerative ai engineer\b",
    r"\bgenai engineer\b", r"\bllm engineer\b", r"\bai software engineer\b", r"\bmachine learning software engineer\b", r"\bai infrastructure engineer\b",
    r"\bml infrastructure engineer\b", r"\bai platform engineer\b", r"\bml platform engineer\b", r"\bai research engineer\b",
    r"\bmachine learning research engineer\b", r"\banalytical ai engineer(?:ing)?\b",
    r"\b(?:computer vision|machine learning|deep learning|ai|ml) algorithms? developer\b", r"\bmachine learning (?:infrastructure|platform) engineer\b",
    r"\b(?:ai|ml|machine learning|llm|genai|generative ai|inference)\b(?:\s+\w+){0,2}\s+(?:infrastructure|platform) engineer\b",
    r"\b(?:infrastructure|platform) engineer\b.*\b(?:generative ai|genai|llm|machine learning|ml|ai)\b", r"\bengineer[\s,/-]+ai\b", r"\bengineer[\s,/-]+ml\b",
    r"\bengineer[\s,/-]+machine learning\b",
)
RELIABILITY = (
    r"\bsite[- ]reliability\b", r"\bsre\b", r"\b(?:software|systems?|production|services?|infrastructure|platform|cloud|database|network|devops)\b.*\breliability\b",
    r"\breliability\b.*\b(?:software|infrastructure|platform|cloud|devops)\b",
)
MOBILE = (
    r"\bios\b(?![\s-]*(?:xr|xe|xrv|xrd)\b)", r"\b(?:ipados|watchos|visionos|tvos)\b", r"\bandroid\b", r"\breact[- ]native\b", r"\bflutter\b", r"\bswiftui\b",
    r"\bswift (?:software )?(?:engineer|developer)\b",
    r"\bmobile (?:software|app(?:lication)?s?|frontend|front[- ]end|client|platform|infrastructure|sdk) (?:engineer(?:ing)?|developer|programmer)\b",
    r"\bmobile developer\b", r"\bmobile engineer(?:ing)?\b(?=.*\b(?:app|apps|software)\b)",
    r"\b(?:software|frontend|front[- ]end|client|product|platform|sdk) (?:engineer(?:ing)?|developer)\b.*(?<![a-z]-)\bmobile\b(?!,?\s+(?:al|alabama)\b)(?!\s+(?:wireless|networks?|networking|broadband|carriers?|telecom\w*|5g|lte|robot\w*|manipulation|autonomy)\b)",
    r"\bswe\b.*(?<![a-z]-)\bmobile\b(?!,?\s+(?:al|alabama)\b)(?!\s+(?:wireless|networks?|networking|broadband|carriers?|telecom\w*|5g|lte|robot\w*|manipulation|autonomy)\b)",
)
INFRASTRUCTURE = (
    r"(?<!data )\binfrastructure engineer(?:ing)?\b", r"(?<!data )\bplatform engineer(?:ing)?\b",
    r"\bcloud (?:software |infrastructure |platform |solutions? )?(?:engineer(?:ing)?|developer|architect)\b", r"\bdev[ -]?ops\b", r"\bdevsecops\b",
    r"\bmember of technical staff\b.*(?<!data )\b(?:infrastructure|platform|cloud)\b",
    r"(?<!data )\b(?:infrastructure|platform|cloud)\b.*\bmember of technical staff\b",
)
DEVOPS = (
    r"\bdev[ -]?ops\b", r"\bdevsecops\b",
)
CORE_SOFTWARE = (
    r"\bsoftware (?:engineer(?:ing)?|developer|development engineer)\b", r"\bsde\b", r"\bswe\b", r"\bsw (?:engineer|developer)\b", r"\bback[- ]?end\b",
    r"\bfront[- ]?end\b", r"\bfull[- ]?stack\b", r"\bfounding\b(?:\s+\w+){0,2}\s+engineer\b",
    r"\bsoftware (?:tools?|integration|systems?) (?:engineer(?:ing)?|developer|programmer)\b", r"\bsoftware systems? integration engineer(?:ing)?\b",
)
MOBILE_AND_MORE = (
    r"\bfull[- ]?stack\b", r"\bback[- ]?end\b", r"\bweb\b", r"\bsoftware (?:engineer|developer)\s*(?:/|\bor\b)\s*mobile\b",
    r"\bmobile (?:engineer|developer)\s*(?:/|\bor\b)\s*software\b",
)
SOFTWARE = (
    r"\bsoftware engineer(?:ing)?\b", r"\bsoftware development engineer(?:ing)?\b", r"\bsde\b", r"\bsoftware dev\.? engineer\b", r"\bsoftware developer\b",
    r"\bsoftware (?:tools?|integration|systems?) (?:engineer(?:ing)?|developer|programmer)\b", r"\bsoftware systems? integration engineer(?:ing)?\b",
    r"\bsoftware (?:(?:engineering|development) )?(?:rotation(?:al)?(?: development)?|development) program(?:me)?\b",
    r"\b(?:leadership )?development program(?:me)?\s*[-,\u2013\u2014:/]\s*engineering\s*[-,\u2013\u2014:/]\s*software discipline\b", r"\balgorithms? developer\b",
    r"\bsystems software engineer(?:ing)?\b", r"\bbackend software engineer(?:ing)?\b", r"\bbackend engineer(?:ing)?\b", r"\bbackend developer\b",
    r"\bfull[- ]?stack software engineer(?:ing)?\b", r"\bfull[- ]?stack engineer(?:ing)?\b", r"\bfull[- ]?stack developer\b",
    r"\bplatform software engineer(?:ing)?\b", r"\binfrastructure software engineer(?:ing)?\b", r"\bdistributed systems engineer(?:ing)?\b",
    r"\bfront[- ]?end (?:software )?(?:engineer(?:ing)?|developer)\b", r"\bback[- ]?end (?:software )?(?:engineer(?:ing)?|developer)\b",
    r"\bweb (?:software |application )?(?:engineer|developer)\b", r"\bapplications? developer\b", r"\b(?:software|sw|ai) applications? development engineer\b",
    r"\bsw (?:engineer|developer)\b",
    r"\b(?:java|python|golang|go|ruby|scala|kotlin|swift|react|javascript|typescript|node(?:\.js)?|php) (?:software )?(?:engineer|developer)\b",
    r"(?:^|[^a-z0-9])(?:(?:vb|asp)?\.net|c#|c\+\+) (?:software )?(?:engineer|developer|programmer)\b", r"\bfull[- ]?stack\b",
    r"\b(?:associate|junior|entry[- ]level) (?:software )?developer\b", r"\bui(?:/ux)? (?:software )?(?:engineer|developer)\b",
    r"\bgameplay (?:software )?(?:engineer|developer|programmer)\b", r"\bgame (?:software )?(?:engineer|developer|programmer)\b",
    r"\b(?:graphics|rendering) (?:software )?engineer\b",
    r"\b(?:software|application|web|php|java|python|research|engine|tools|graphics|rendering|animation(?: systems)?|physics|audio|network|online|build|ui|ai|gameplay) programmer\b",
    r"\b(?:associate|junior|entry[- ]level) programmer\b", r"\bprogrammer[/ ]analyst\b", r"\banalyst[/ ]programmer\b", r"\bfounding\b(?:\s+\w+){0,2}\s+engineer\b",
    r"\bmember of technical staff\b", r"\bswe\b",
)
DATA_ENGINEERING = (
    r"\bdata engineer(?:ing)?\b(?!\s*(?:analyst|manager|director|lead)\b)", r"\banalytics engineer(?:ing)?\b",
    r"\bdata (?:platform|infrastructure|pipeline) engineer\b", r"\bbig data (?:engineer|developer)\b", r"\betl (?:engineer|developer)\b",
)
DATA_SCIENCE = (
    r"\bdata scientist\b", r"\bdata science\b(?!\s*(?:manager|director|lead)\b)", r"\bdecision scientist\b", r"\bapplied scientist\b",
    r"\b(?:machine learning|ml) scientist\b",
)

#: Specialties of technical staff that are not software, and those that are machine learning.
STAFF_ELSEWHERE = (
    r"[,;:/(\-]\s*it\s*\)?\s*$|\b(?:information technology|customer success|developer relations|gtm|go[- ]to[- ]market|fleet operations|business systems)\b",
    r"\b(?:brand marketing designer|product design|web design|design engineer)\b",
    r"\b(?:analog design|chip design|thin films?|soc|physical design|physical architect)\b",
    r"\b(?:computational biolog(?:ist|y)|statistical genetics|translational medicine)\b", r"(?:[,;:/-]\s*)science\s*$", r"\bproduct engineers?\b",
)
STAFF_LEARNING = (
    r"\b(?:ai|ml|machine learning|llm|genai|inference|rl|pre[- ]?training|post[- ]?training)\b.*\b(?:infrastructure|platform)\b",
    r"\b(?:infrastructure|platform)\b.*\b(?:ai|ml|machine learning|llm|genai|inference|rl|pre[- ]?training|post[- ]?training)\b",
)

#: Titles above the first rungs.
SENIOR = (
    r"\bsenior+\b", r"\bsr\.?\b", r"\bstaff\b", r"\bprincipal\b", r"\bdistinguished\b", r"^\s*fellow\b", r"\b(?:technical|corporate|engineering)\s+fellow\b",
    r"\blead\b", r"\bleaders?\b", r"\bsupervisor\b", r"\bmanaging\s+(?:engineer|scientist)\b", r"\bchief\b(?!\s+(?:data\s+)?office\b)", r"\bmanager\b", r"\bmgrs?\b",
    r"\bdirector\b", r"\bhead\s+of\b", r"(?<!assistant )(?<!associate )\bvice[- ]president\b", r"\b[se]?vp\b", r"\bengineer\s+iv\b",
    r"\b(?:engineer|developer|scientist|architect|programmer)\s*[-\u2013,]?\s*[4-9]\b(?!\s*(?:to|[-\u2013])\s*\d)(?!\s*(?:month|week|year|day|hour)s?\b)",
    r"\blevel\s*[-\u2013]?\s*[4-9]\b", r"\(\s*L[4-9]\s*\)", r"\b(?:engineer|developer|scientist|architect|programmer)\s+L[4-9]\b",
)
LEVEL_THREE = r"\b(?:engineer|developer|scientist|architect|programmer|analyst)\s+iii\b"

#: Titles of engagements that are not full-time employment.
CONTRACT = r"(?<!smart )\bcontract(?:or|ors)?\b|\bfreelance(?:r|rs)?\b|\btemporary\b|\bfixed[- ]term\b|\bai\s+(?:trainer|tutor)s?\b"
PART_TIME = r"\bpart[-_\s]?time\b"
FULL_TIME = r"\bfull[-_\s]?time\b"
INTERNSHIP = (
    r"\bintern(?:ship)?s?\b", r"\bextern(?:ship)?s?\b", r"\bco[-\s]?op\b", r"\bsummer\s+analyst\b", r"\bindustrial\s+placement\b", r"\bplacement\s+year\b",
    r"\bworking\s+student\b", r"\bwerkstudent\b", r"\bpart[-\s]?time\s+student\b", r"\bstudent\s+worker\b", r"\bstudent\s+assistant\b", r"\binterships?\b",
    r"\bapprentice(?:ship)?\b", r"\bpraktikum\b",
)
FORMER_INTERNS = r"\(\s*for\s+(?:current\s*/\s*previous|previous|former|prior|past)\s+[^()]{0,80}?\binterns?\s+only\s*\)"
PARTICIPANT = r"\bjoin(?:ing)?\b[^.!?\n]{0,80}\bas\s+(?:an?\s+)?participant\b"
PAID_TASK = r"\bpaid\s+tasks?\b"

#: Specialisms.
SECURITY = (
    r"\bsecurity\b", r"\bappsec\b", r"\binfosec\b", r"\bcyber\s*security\b", r"\bcyber\b(?![-\s]+(?:physical|monday)\b)", r"\bpenetration\s+test",
    r"\bvulnerability\b", r"\bcryptograph", r"\b(?:trust|integrity)\s*(?:and|&|/)\s*safety\b", r"\buser\s+and\s+entity\s+behaviou?r\s+analytics\b",
)
HARDWARE = (
    r"\bembedded\b", r"\bfirmware\b", r"\bhardware\b", r"\bfpga\b", r"\basic\b", r"\brtos\b", r"\bverilog\b", r"\bvhdl\b", r"\bsilicon\b", r"\bpcb\b",
    r"\bbring-?up\b", r"\bdevice\s+driver", r"\belectrical\s+engineer", r"\bmechatronics\b", r"\bboard\s+support\b",
)
HARDWARE_MARKERS = (
    "bare metal", "bare-metal", "microcontroller", "device driver", "board support package", "board bring-up", "real-time operating system", "rtos", "firmware",
    "fpga", "verilog", "vhdl", "embedded linux", "embedded systems", "oscilloscope", "logic analyzer", "soldering", "schematic", "i2c", "spi bus", "uart", "can bus",
)
PRODUCT_ENGINEER = (
    r"\bproduct engineers?\b",
)

#: Languages; the last one of the first list and the last list tell capitals apart.
SYSTEMS_LANGUAGES = (
    r"c\+\+", r"\bcpp\b", r"\bc/c\+\+", "(?<![A-Za-z0-9+#])C(?![A-Za-z0-9+#])",
)
OTHER_LANGUAGES = (
    r"\bpython\b", r"\bjava\b", r"\bjavascript\b", r"\btypescript\b", r"\bgolang\b", r"\brust\b", r"\bscala\b", r"\bkotlin\b", r"\bswift\b", r"\bruby\b", r"\bc#",
    r"\bc\s?sharp\b", r"\bphp\b", r"\bmatlab\b", r"\bjulia\b", r"\bperl\b", r"\bhaskell\b", r"\belixir\b", r"\berlang\b", r"\bclojure\b", r"\bdart\b", r"\blua\b",
    r"\bobjective-?c\b", r"\bsql\b", r"\bshell\s+script", r"\bbash\b", r"\bterraform\b", r"\bgroovy\b", r"\bf#", r"\bocaml\b", r"\bzig\b",
)
CAPITAL_LANGUAGES = (
    r"\bGo\b", r"\bR\b",
)

#: Early careers.
EARLY_CAREER = (
    r"\bnew\s?grad(?:uate)?\b", r"\brecent\s+graduate\b", r"\buniversity\s+(?:graduate|hire|program|recruiting)\b", r"\bcollege\s+(?:grad|graduate|hire)\b",
    r"\bentry[-\s]level\b", r"\bearly\s+career\b", r"\bearly[-\s]in[-\s]career\b", r"\bcampus\b", r"\brotational\b",
    r"\bgraduate\s+(?:software|engineer|program|scheme)\b", r"\bjunior\b", r"\bassociate\s+(?:software\s+|data\s+)?(?:engineer|scientist)\b",
    r"\b20\d\d\s+(?:grad|start|graduate)\b", r"\b(?:software\s+engineer|sde|swe|engineer|developer|scientist)\s*(?:i|1)\b(?![iv\d])",
)
NEW_GRAD = (
    r"\bnew\s?grad(?:uate)?\b", r"\brecent\s+graduate\b", r"\buniversity\s+(?:graduate|hire|program|recruiting)\b", r"\bcollege\s+(?:grad|graduate|hire)\b",
    r"\bcampus\b", r"\bgraduate\s+(?:software|engineer|program|scheme)\b", r"\b20\d\d\s+(?:grad|start|graduate)\b",
)

#: Doctorates and other degrees.
DOCTOR_TITLE = (
    r"\bph\.?\s*d\.?s?\b", r"\bdoctoral\b", r"\bdoctorate\b", r"\bpost[- ]?doctoral\b", r"\bpost[- ]?doc\b",
)
DOCTOR_REQUIRED = (
    r"\bph\.?\s*d\.?\s+(?:is\s+)?required\b", r"\bph\.?\s*d\.?\s+in\s+[^.;]{1,100}\s+(?:is\s+)?required\b", r"\brequires?\s+(?:an?\s+)?ph\.?\s*d\.?\b",
    r"\bmust\s+(?:have|hold|possess)\s+(?:an?\s+)?ph\.?\s*d\.?\b", r"\bdoctoral\s+degree\s+(?:is\s+)?required\b", r"\brequires?\s+(?:an?\s+)?doctoral\s+degree\b",
    r"\bdoctorate\s+(?:is\s+)?required\b", r"\brequires?\s+(?:an?\s+)?doctorate\b",
)
DOCTORATE = r"\bph\.?\s*d\.?(?!\w)|\bdoctoral\s+degree\b|\bdoctorate\b"
OTHER_DEGREE = r"\b(?:bachelor(?:['\u2019]?s)?|master(?:['\u2019]?s)?|b\.?s\.?c?\.?|m\.?s\.?c?\.?|b\.?a\.?|m\.?a\.?)\b"

#: Demands for citizenship, and ways of obtaining a licence that open them.
CITIZEN_PHRASES = (
    "must be a u.s. citizen", "must be a us citizen", "u.s. citizenship required", "us citizenship required", "requires u.s. citizenship", "requires us citizenship",
    "only u.s. citizens", "only us citizens", "must be a u.s. person", "must be a us person", "u.s. person required", "us person required",
)
CITIZEN_PATTERNS = (
    r"\bitar\s+requirements?\b", r"\bitar[-\s]controlled\b", r"subject\s+to\s+(?:the\s+)?itar\b", r"conform\s+to\s+u\.?\s?s\.?\s+government\s+export",
    r"export[^.]{0,120}?\bwithout\s+(?:(?:sponsorship|the\s+need)\s+(?:for|of)\s+|obtaining\s+|requiring\s+)?(?:an?\s+)?(?:export\s+)?licen[cs]e\b",
    r"\bwithout\s+(?:(?:sponsorship|the\s+need)\s+(?:for|of)\s+|obtaining\s+|requiring\s+)?(?:an?\s+)?(?:export\s+)?licen[cs]e\b[^.]{0,120}?export",
    r"\bonly\s+(?:for|to)\s+(?:u\.?\s?s\.?|united\s+states)\s+(?:persons?|citizens?)\b",
    r"\b(?:open|available|limited|restricted)\s+(?:only\s+)?to\s+(?:u\.?\s?s\.?|united\s+states)\s+(?:persons?|citizens?)\b",
    r"""requir\w*\s+[\"\u201c\u201d']?\s*(?:u\.?\s?s\.?|united\s+states)\s+persons?\s*[\"\u201c\u201d']?\s+status\b""",
    r"""\b(?:qualify\s+as|meet\s+the\s+definition\s+of)\s+an?\s+[\"\u201c\u201d']?(?:u\.?\s?s\.?|united\s+states)\s+person\b""",
    r"\bto\s+be\s+an?\s+(?:u\.?\s?s\.?|united\s+states)\s+(?:person|citizen)\b", r"\(\s*i\s*\)\s*(?:u\.?\s?s\.?|united\s+states)\s+citizen\s+or\s+national\b",
    r"\bitar\b[^.]{0,150}?\b(?:u\.?\s?s\.?|united\s+states)\s+persons?\b", r"\b(?:u\.?\s?s\.?|united\s+states)\s+persons?\b[^.]{0,150}?\bitar\b",
    r"\bcitizenship\s+will\s+be\s+verified\b", r"\bcitizenship\s*(?:&|and)\s*citizenship\s+verification\b",
    r"must\s+be\s+(?:an?\s+)?(?:\(\s*[ivx\d]{1,4}\s*\)\s*)?(?:an?\s+)?(?:u\.?\s?s\.?|united\s+states)\s*(?:citizen|national|person)\b",
    r"(?:u\.?\s?s\.?|united\s+states)\s+citizenship[^.]{0,80}?required\b", r"requires?\s+(?:u\.?\s?s\.?|united\s+states)\s+citizenship\b",
    r"only\s+(?:u\.?\s?s\.?|united\s+states)\s+citizens\b", r"restricted\s+to\s+(?:u\.?\s?s\.?|united\s+states)\s+citizens\b",
    r"(?:u\.?\s?s\.?|united\s+states)\s+persons?\s+(?:only|required|as\s+defined)\b", r"due\s+to\s+federal\s+contract\s+requirements[^.]{0,90}citizenship",
    r"citizenship[^.]{0,40}(?:is\s+)?(?:a\s+)?requirement\b", r"(?:u\.?\s?s\.?|united\s+states)\s+person\s+status[^.]{0,30}required\b",
    r"\bare\s+a\s+(?:u\.?\s?s\.?|united\s+states)\s+person\b", r"\b(?:u\.?\s?s\.?|united\s+states)\s+citizen\s+or\s+(?:lawful\s+)?permanent\s+resident\b",
    r"\b(?:usc|(?:u\.?\s?s\.?\s+)?citizens?)\s*(?:/|\bor\b|&|\band\b)\s*(?:gc|green\s*card)s?(?:\s+holders?)?\b(?![^.\n]{0,25}?\b(?:opt|cpt|ead|h-?1b?|h-?4|tn|stem|work\s+permit)\b)",
    r"\b(?:gc|green\s*card)s?(?:\s+holders?)?\s*(?:/|\bor\b|&|\band\b)\s*(?:usc|(?:u\.?\s?s\.?\s+)?citizens?)\b(?![^.\n]{0,25}?\b(?:opt|cpt|ead|h-?1b?|h-?4|tn|stem|work\s+permit)\b)",
)
LICENCE_ROUTES = (
    r"eligible\s+for\s+(?:a\s+|an\s+)?(?:deemed\s+)?export\s+licen[cs]", r"eligible\s+for\s+(?:(?:u\.?\s?s\.?\s+)?government\s+)?authori[sz]ation",
    r"\bobtain(?:ing|ed)?\s+(?:an?\s+|any\s+)?(?:necessary\s+|required\s+)?(?:u\.?\s?s\.?\s+government\s+)?(?:export\s+)?licen[cs]e",
    r"\bapply\s+for\s+an?\s+(?:u\.?\s?s\.?\s+)?(?:government\s+)?(?:export\s+)?licen[cs]e", r"\bexport\s+licen[cs]ing\s+(?:review|process|approval)",
    r"\bexport\s+control\s+approval\b", r"\btechnology\s+control\s+plan\b",
)
LICENCE_CLOSED = r"without\s+(?:(?:sponsorship|the\s+need)\s+(?:for|of)\s+|obtaining\s+|requiring\s+)?(?:an?\s+)?(?:export\s+)?licen[cs]e"
EXPORT_CONTROL = r"\bexport[\s-]+control|\bexport\s+administration\s+regulations\b|\bexport\s+(?:laws|regulations|restrictions)\b|\bdeemed\s+export\b"

#: Clearances and sponsorship.
CLEARANCE_PHRASES = (
    "active security clearance required", "must possess a security clearance", "must hold a security clearance", "active secret clearance",
    "active top secret clearance",
)
CLEARANCE_PATTERNS = (
    r"\bsecurity\s+clearance\b", r"\bsecret\s+clearance\b", r"\bts\s*[/-]?\s*sci\b", r"\bts\s+clearance\b", r"\btop\s+secret\b", r"\bpolygraph\b",
    r"\bdod\s+clearance\b", r"\bclearable\b", r"\bq\s+clearance\b", r"\brequired\s+clearance\s*:\s*(?:active\s+)?(?:secret|ts|q)\b",
    r"(?:^|[.\n])\s*clearance\s*:\s*must\s+be\s+eligible\s+(?:and\s+willing\s+)?to\s+obtain\s+(?:a\s+)?clearance\b",
)
CLEARANCE_TITLES = (
    r"\bcleared\b", r"\bpoly\b", r"\bctj\b", r"\bclearance\b", r"\bsecret\b",
)
SPONSOR_PHRASES = (
    "without current or future sponsorship", "without the need for current or future sponsorship", "will not sponsor", "will not provide sponsorship",
    "unable to provide sponsorship", "unable to sponsor", "cannot provide sponsorship", "cannot sponsor", "no visa sponsorship", "no sponsorship available",
    "sponsorship is not available",
)
SPONSOR_PATTERNS = (
    r"\bnot\s+eligible\s+for\b[^\n]{0,40}?\bsponsorship\b", r"\bineligible\s+for\b[^\n]{0,40}?\bsponsorship\b",
    r"\b(?:cannot|can't|unable\s+to|not\s+able\s+to)\s+(?:provide|offer)\s+(?:(?:employment|work|immigration|visa)\s+){1,3}sponsorship\b(?!\s+(?:for\s+)?(?:every|all)\b)",
    r"\b(?:do|does|will)\s+not\s+(?:provide|offer)\s+(?:(?:employment|work|immigration|visa)\s+){1,3}sponsorship\b(?!\s+(?:for\s+)?(?:every|all)\b)",
    r"\bunable\s+to\s+consider\s+candidates\s+who\s+require\s+(?:visa\s+)?sponsorship\s+for\s+(?:this|the)\s+(?:role|position)\b",
    r"\bnot\s+considering\s+applicants\s+(?:that|who)\s+(?:need|require)\s+(?:any\s+type\s+of\s+)?(?:(?:immigration|visa|work)\s+)?sponsorship\b",
    r"\bwithout\s+visa\s+sponsorship\s+now\s+or\s+in\s+the\s+future\b", r"\bmust\s+not\s+require\s+(?:visa\s+)?sponsorship\b",
    r"\bno\s+(?:visa\s+)?sponsorship\s+(?:is\s+)?offered\s+for\s+(?:this|the)\s+(?:position|role)\b",
    r"\bnot\s+available\s+for\s+(?:any\s+)?(?:work|visa|immigration)\s+sponsorship\b",
    r"\bmust\b[^.;\n]{0,70}\bwork\s+authori[sz]ation\b[^.;\n]{0,45}\bdoes\s+not\s+now\s+or\s+in\s+the\s+future\s+require\s+sponsorship\s+of\s+(?:an?\s+)?visa\b",
    r"\bnot\s+offering\s+relocation\s*,\s*sponsorship\s*,\s*and\b",
    r"\bsponsorship\s+of\s+new\s+applicants\s+for\s+employment\s+authori[sz]ation(?:(?!\b(?:but|however)\b)[^.;\n]){0,120}?\bis\s+not\s+available\b",
)

#: Headers of sections, and words that make a clause optional.
PREFERRED_HEADERS = (
    r"preferred\s+qualifications", r"preferred\s+requirements", r"nice[-\s]to[-\s]have", r"bonus\s+points", r"desired\s+qualifications", r"good\s+to\s+have",
    r"(?:the\s+)?extras\s+that\s+set\s+you\s+apart", "pluses", r"it'?s\s+a\s+plus", r"desired\s+capabilities", r"desired\s+skills", r"ideally\s+you",
)
REQUIRED_HEADERS = (
    r"minimum\s+qualifications", r"basic\s+qualifications", r"required\s+qualifications", "requirements", r"what\s+you['\u2019]?ll\s+need",
    r"what\s+we['\u2019]?re\s+looking\s+for", r"what\s+are\s+we\s+looking\s+for", r"who\s+you\s+are", r"about\s+you", r"what\s+we\s+need\s+to\s+see",
    r"qualifications\s+we\s+need", r"what\s+you['\u2019]?ll\s+bring", r"what\s+you\s+bring", r"your\s+(?:skills\s+and\s+)?experience", r"skills\s+and\s+experience",
    r"your\s+background", r"must\s+haves?", r"you\s+(?:will\s+)?have", r"you['\u2019]ll\s+have", "qualifications",
)
OPTIONAL_WORDS = (
    "preferred", "nice to have", "nice-to-have", "bonus", "ideally",
)

#: Figures of experience.
EXPERIENCE_CONTEXT = r"(?:of\s+|in\s+|with\s+)?(?:[A-Za-z][\w/+#.\-]*[\s,]+){0,6}?(?:experience|expertise|background|building|shipping|working|developing|designing|writing|programming|engineering|managing|leading|operating|architecting|maintaining|supporting|development|engineer|software|industry|professional|roles?|positions?)"
PLUS = r"(?:\+|\(\s*\+\s*\))"
WRITTEN_NUMBER = r"(?:(?:twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)(?:[-\s]+(?:one|two|three|four|five|six|seven|eight|nine))?|nineteen|eighteen|seventeen|sixteen|fifteen|fourteen|thirteen|twelve|eleven|zero|one|two|three|four|five|six|seven|eight|nine|ten)"
COLLECTIVE = r"(?:our|the)\s+(?:team|company|(?:\w+\s+)?(?:co[-\s]?)?founders?|leadership|group)\s+(?:has|have|brings?|combines?|bring|share)\b[^.]{0,30}$|\bcombined\b[^.]{0,24}$|\bcollectively\b[^.]{0,24}$|\bwe\s+have\b[^.]{0,36}$"
CEILING = r"(?:no\s+more\s+than|not\s+more\s+than|at\s+most|up\s+to|fewer\s+than|less\s+than|under|within|maximum\s+of|max\.?)\s*$"
FLOOR_BEFORE = r"(?:at\s+least|minimum\s+of|minimum|min\.?|over|more\s+than|no\s+less\s+than)\s*$"
FLOOR_AFTER = r"^\s*(?:\+|(?:years?|yrs?)?\s*(?:or\s+more|or\s+greater|or\s+above|and\s+above|plus\b))"

#: Limits in years, code points, and distinct words.
EARLY_YEARS, MOST_YEARS, MOST_OPEN_YEARS = 2, 4, 3
SECTION_REACH, LICENCE_REACH = 1200, 200
LEAST_MARKERS = 3
