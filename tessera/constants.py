"""Word lists, tables and thresholds that results depend on."""

# Fixed values. Comments that narrate what code does start with one of these.
NARRATION_MARKERS = (
    "first we", "first,", "now we", "now,", "now let", "next we",
    "next,", "then we", "then,", "finally we", "finally,", "here we",
    "here,", "let's", "let me", "we need to", "we can ", "we'll",
    "we will", "step 1", "step 2", "step 3",
)

# Fixed values. Words that are never identifiers.
KEYWORDS = tuple(
    """
    auto break case catch char class const continue default do double else enum extern false
    float for goto if int long new null private protected public register return short signed
    sizeof static struct super switch this throw true try typedef typeof union unsigned var void
    volatile while async await delete export extends finally from function import in instanceof let of
    undefined yield chan defer fallthrough func go interface map package range select type as crate
    dyn fn impl loop match mod move mut pub ref self trait unsafe use where
    def elif except global lambda nonlocal pass raise with
    """.split()
)

# Fixed values. Identifiers that say nothing.
GENERIC_NAMES = tuple(
    """
    data result response handler value item config options params callback
    output input temp tmp ret res val obj arr args
    opts payload instance container wrapper helper util manager service controller
    processor middleware utils helpers entries items values results responses
    """.split()
)

# Fixed values. Words of a parameter list that are not parameters' names.
PARAMETER_WORDS = tuple(
    """
    self cls this super int long short double float char bool boolean string number void byte var let
    const auto unsigned signed static final readonly public private protected abstract virtual
    override async func def return nil null undefined true false error err ctx any object unknown
    Request Response Context interface struct class enum
    """.split()
)

# Fixed values. Words that count as conditionals, and words that start control lines.
CONDITIONALS = ("if", "else", "elif", "switch", "case", "match")
CONTROL_WORDS = ("if", "else", "for", "while", "switch", "do", "try", "catch", "finally", "defer", "case", "default")
TYPE_WORDS = ("struct", "enum", "union", "interface", "typedef")

# Fixed values. File extensions: family and language.
C_LIKE, PYTHON, SHELL = "c-like", "python", "shell"
EXTENSIONS = (
    (".ts", C_LIKE, "ts"), (".tsx", C_LIKE, "ts"), (".js", C_LIKE, "js"), (".jsx", C_LIKE, "js"), (".go", C_LIKE, "go"),
    (".c", C_LIKE, "c"), (".h", C_LIKE, "c"), (".cc", C_LIKE, "cpp"), (".cpp", C_LIKE, "cpp"), (".cxx", C_LIKE, "cpp"),
    (".hpp", C_LIKE, "cpp"), (".cs", C_LIKE, "other"), (".java", C_LIKE, "java"), (".rs", C_LIKE, "rust"),
    (".swift", C_LIKE, "swift"), (".kt", C_LIKE, "other"), (".scala", C_LIKE, "other"), (".m", C_LIKE, "other"),
    (".mm", C_LIKE, "other"), (".dart", C_LIKE, "other"), (".php", C_LIKE, "other"), (".zig", C_LIKE, "other"),
    (".py", PYTHON, "python"), (".pyi", PYTHON, "python"), (".pyw", PYTHON, "python"),
    (".sh", SHELL, "shell"), (".bash", SHELL, "shell"), (".zsh", SHELL, "shell"), (".fish", SHELL, "shell"), (".ksh", SHELL, "shell"),
)
EXTRA_EXTENSIONS = (".rb", ".lua", ".pl", ".pm", ".r", ".R", ".jl")
SKIP_SUFFIXES = (".min.js", ".min.css", ".pb.go", ".generated.cs", ".pb.h", ".pb.cc", ".lock")
SKIP_FOLDERS = (
    "node_modules", "vendor", ".git", "build", "dist", "target", "__pycache__",
    ".venv", "venv", ".tox", ".mypy_cache", ".next", ".nuxt", "coverage",
)
GENERATED_MARKS = ("Code generated", "DO NOT EDIT", "@generated")

# Fixed values. Functions that a runtime or framework calls.
ENTRY_POINTS = ("main", "init", "constructor", "render", "setup", "teardown")
LIFECYCLE = tuple(
    """
    componentDidMount componentDidUpdate componentWillUnmount shouldComponentUpdate
    getDerivedStateFromProps getSnapshotBeforeUpdate ngOnInit ngOnDestroy ngOnChanges ngAfterViewInit
    ngAfterContentInit ngDoCheck mounted created beforeMount beforeDestroy updated unmounted
    getServerSideProps getStaticProps getStaticPaths getInitialProps loader action
    """.split()
)
GO_HOOKS = ("BeforeCreate", "AfterCreate", "BeforeUpdate", "AfterUpdate", "BeforeSave", "AfterSave", "BeforeDelete", "AfterDelete")

# Fixed values. Prefixes of conventional commit messages.
COMMIT_TYPES = ("feat", "fix", "chore", "docs", "style", "refactor", "test", "ci", "perf", "build")

# Thresholds.
FLAGGED, MODERATE, MILD = 0.85, 0.60, 0.40
CLAMP, CLAMP_UNCALIBRATED, CLAMP_NO_RATIO, CLAMP_SMALL = 3.0, 1.5, 1.5, 1.0
LEAST_LINES, LEAST_DEFECTS, TREND = 60, 4, 0.5
GRADIENT_LINES, GRADIENT_COMMENTS, GRADIENT = 25, 6, 3.0
RATIO_RANGE, ENTROPY_RANGE, SPREAD_RANGE = (0.10, 0.35), (0.30, 0.60), (0.15, 0.75)  # low end, width
BUCKET_WIDTH, BUCKETS = 5, 100
LEAST_COMPRESSED, LEAST_BODY = 500, 200
DUPLICATE_DISTANCE, SIZE_RATIO = 0.30, 2.0
UNIQUE_CAP, NARRATION_CAP, FINDINGS_CAP, COMMITS = 2048, 128, 512, 20

# Default parameters: mean and deviation of machine-written and of human code.
GAUSSIAN = {
    "regularity": (0.50, 0.18, 0.20, 0.13),
    "ccr": (0.25, 0.15, 0.04, 0.10),
    "cond": (0.18, 0.10, 0.10, 0.10),
    "dup": (0.22, 0.12, 0.10, 0.15),
    "git": (0.55, 0.20, 0.25, 0.22),
    "ident": (0.18, 0.08, 0.07, 0.04),
    "func_cv": (0.40, 0.20, 0.90, 0.35),
    "ttr": (0.35, 0.15, 0.40, 0.20),
    "indent": (0.45, 0.22, 0.70, 0.25),
}
# Probability of a pattern in machine-written and in human code.
BINARY = {"narration": (0.40, 0.01), "decay": (0.25, 0.05), "overwrap": (0.18, 0.01), "namebreak": (0.15, 0.02)}
TEMPERATURE = 2.0

#: Bytes in which the parameters of a function are looked for.
SIGNATURE = 512
#: Name of a calibration file that is looked for where the tool runs and beside what it looks at.
CALIBRATION_FILE = "tessera-calibration.json"
