"""The fixed catalogue: which calls have which effect, and the word lists around it, with the tables made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Effects in bit order, with (stage in a sentence, place in the bar code). Fixed values.
EFFECTS = "fs_read fs_write fs_delete net process env dynamic stdout random clock concurrency compute exit".split()
STAGE = {"fs_read": 0, "fs_write": 2, "fs_delete": 2, "net": 0, "process": 2, "env": 0, "dynamic": 2, "stdout": 3, "random": 1, "clock": 1, "concurrency": 1, "compute": 1, "exit": 3}
BARCODE = "fs_read fs_write fs_delete | net process env | dynamic | compute random clock concurrency | stdout exit"
SEVERITIES = "info notable caution".split()
BANDS = "inert routine check read".split()

#: For each effect, lines of: severity | verb | target argument (a position, name/position, - for none) | note | callees. Fixed values.
RULES = {
    "fs_read": """
info | list | 0 |  | os.listdir os.scandir
info | walk | 0 |  | os.walk
info | stat | 0 |  | os.stat os.path.getsize
info | test | 0 |  | os.path.exists os.path.isfile os.path.isdir
info | glob | 0 |  | glob.glob glob.iglob <path>.glob <path>.rglob
info | parse | 0 |  | json.load tomllib.load csv.reader csv.DictReader yaml.safe_load
info | read | filepath_or_buffer/0 |  | pandas.read_csv
info | read | 0 |  | pandas.read_parquet pandas.read_json pandas.read_excel pandas.read_hdf pandas.read_table numpy.load numpy.loadtxt numpy.genfromtxt numpy.fromfile cv2.imread PIL.Image.open nibabel.load
info | query | 0 |  | pandas.read_sql
info | open | 0 |  | h5py.File zipfile.ZipFile tarfile.open tarfile.TarFile sqlite3.connect
info | read | - |  | <path>.read_text <path>.read_bytes <file>.read <file>.readlines <file>.readline
info | list | - |  | <path>.iterdir
info | test | - |  | <path>.exists <path>.is_file <path>.is_dir
info | stat | - |  | <path>.stat <path>.resolve
info | open | - |  | <path>.open
info | expand | 0 |  | os.path.expanduser
info | parse | 0 | XML parsing | xml.etree.ElementTree.parse
notable | open | 0 |  | shelve.open
""",
    "net": """
info | body | - |  | <response>.json <response>.text <response>.read <response>.iter_content
info | HEAD | 0 |  | requests.head <session>.head
info | recv | - |  | <socket>.recv
info | request | 0 |  | urllib.request.Request
notable | GET | 0 |  | requests.get httpx.get <session>.get
notable | request | 1 |  | requests.request <session>.request <session>.stream httpx.request httpx.stream aiohttp.request
notable | session | - |  | requests.Session httpx.Client httpx.AsyncClient aiohttp.ClientSession urllib3.PoolManager
notable | fetch | 0 |  | urllib.request.urlopen
notable | socket | - |  | socket.socket
notable | connect | 0 |  | socket.create_connection http.client.HTTPConnection http.client.HTTPSConnection ftplib.FTP <socket>.connect <socket>.connect_ex pymongo.MongoClient sqlalchemy.create_engine ftplib.FTP_TLS
notable | mail | 0 |  | smtplib.SMTP imaplib.IMAP4 imaplib.IMAP4_SSL poplib.POP3 smtplib.SMTP_SSL
notable | aws | 0 |  | boto3.client boto3.resource
notable | ws | 0 |  | websockets.connect
notable | listen | 0 | opens a port | <socket>.bind http.server.HTTPServer socketserver.TCPServer
notable | listen | - | opens a port | <socket>.listen
notable | send | - |  | <socket>.send <socket>.sendall
notable | send | 1 |  | <socket>.sendto
notable | browse | 0 |  | webbrowser.open webbrowser.open_new
notable | rpc | 0 |  | xmlrpc.client.ServerProxy
notable | connect | - |  | psycopg2.connect pymysql.connect redis.Redis
notable | api | - |  | openai.OpenAI anthropic.Anthropic
notable | download | 0 |  | huggingface_hub.hf_hub_download huggingface_hub.snapshot_download transformers.AutoModel.from_pretrained transformers.AutoTokenizer.from_pretrained transformers.AutoModelForCausalLM.from_pretrained torch.hub.load
caution | POST | 0 | sends data to a remote host | requests.post httpx.post <session>.post
caution | PUT | 0 | sends data to a remote host | requests.put <session>.put
caution | PATCH | 0 | sends data to a remote host | requests.patch <session>.patch
caution | DELETE | 0 | deletes a remote resource | requests.delete <session>.delete
caution | download | 0 | downloads a remote file to disk | urllib.request.urlretrieve
caution | ssh | - | opens an SSH session | paramiko.SSHClient
caution | PUT | 0 |  | httpx.put
caution | PATCH | 0 |  | httpx.patch
caution | DELETE | 0 |  | httpx.delete
caution | telnet | 0 | opens an unencrypted session | telnetlib.Telnet
caution | ssh | 0 | opens an SSH session | fabric.Connection
""",
    "fs_write": """
info | mkdir | 0 |  | os.makedirs os.mkdir
info | tmpfile | - |  | tempfile.NamedTemporaryFile tempfile.mkstemp
info | tmpdir | - |  | tempfile.mkdtemp tempfile.TemporaryDirectory
info | mkdir | - |  | <path>.mkdir
info | touch | - |  | <path>.touch
info | commit | - |  | <conn>.commit
notable | rename | 0 |  | os.rename <path>.rename
notable | replace | 1 |  | os.replace
notable | link | 1 |  | os.symlink os.link
notable | chmod | 0 |  | os.chmod
notable | chown | 0 |  | os.chown
notable | truncate | 0 |  | os.truncate
notable | copy | 1 |  | shutil.copy shutil.copy2 shutil.copyfile shutil.copytree
notable | move | 1 |  | shutil.move
notable | archive | 0 |  | shutil.make_archive
notable | unpack | 1 |  | shutil.unpack_archive
notable | write | 1 |  | json.dump yaml.dump pickle.dump torch.save
notable | write | 0 |  | numpy.save numpy.savez numpy.savez_compressed numpy.savetxt cv2.imwrite <frame>.to_csv <frame>.to_parquet <frame>.to_json <frame>.to_excel <frame>.to_pickle <frame>.to_sql
notable | plot | 0 |  | matplotlib.pyplot.savefig
notable | write | - |  | <path>.write_text <path>.write_bytes <file>.write <file>.writelines
notable | replace | 0 |  | <path>.replace
notable | chmod | - |  | <path>.chmod
notable | link | 0 |  | <path>.symlink_to <path>.hardlink_to
notable | unpack | - | extracts an archive; member paths decide where | <archive>.extractall
notable | unpack | 0 | extracts an archive; member paths decide where | <archive>.extract
notable | sql | 0 | runs a database statement | <conn>.execute <conn>.executemany
notable | sql | 0 | runs a database script | <conn>.executescript
""",
    "fs_delete": """
caution | delete | 0 | removes a file from disk | os.remove os.unlink
caution | rmdir | 0 | removes a directory | os.rmdir
caution | rmdir | 0 | removes a directory tree | os.removedirs
caution | rmtree | 0 | recursively deletes a directory | shutil.rmtree os.rmtree
caution | delete | - | removes a file from disk | <path>.unlink
caution | rmdir | - | removes a directory | <path>.rmdir
notable | trash | 0 | moves a path to the trash | send2trash.send2trash
""",
    "process": """
caution | run | 0 | runs an external command | subprocess.run subprocess.call subprocess.check_call subprocess.check_output sh.Command plumbum.local
caution | spawn | 0 | spawns an external process | subprocess.Popen os.posix_spawn os.posix_spawnp asyncio.create_subprocess_exec
caution | shell | 0 | runs a command through the shell | subprocess.getoutput subprocess.getstatusoutput os.system os.popen asyncio.create_subprocess_shell
caution | exec | 0 | replaces this process | os.execv os.execvp os.execl os.execle os.execlp os.execlpe os.execve os.execvpe
caution | fork | - | forks the process | os.fork os.forkpty
caution | spawn | 0 | spawns an interactive process | pty.spawn pexpect.spawn
caution | spawn | 1 | spawns an external process | os.spawnl os.spawnle os.spawnlp os.spawnv os.spawnve os.spawnvp
caution | kill | 0 | signals another process | os.kill
caution | kill | 0 | signals a process group | os.killpg
caution | open | 0 | opens a file with its default application | os.startfile
caution | setuid | 0 | changes the process's user | os.setuid
caution | setgid | 0 | changes the process's group | os.setgid
caution | docker | - | talks to the Docker daemon | docker.from_env
notable | start | - | starts a worker process | multiprocessing.Process.start
notable | kill | - | kills the child process | <proc>.kill
notable | kill | - | terminates the child process | <proc>.terminate
notable | signal | 0 | signals the child process | <proc>.send_signal
notable | signal | 0 | raises a signal | signal.raise_signal
info | await | - |  | <proc>.communicate <proc>.wait
info | handler | 0 |  | signal.signal
info | which | 0 | locates an executable | shutil.which
""",
    "env": """
info | getenv | 0 |  | os.getenv os.environ.get
info | probe | - |  | platform.system os.uname os.getcwd os.getlogin os.getpid socket.gethostname platform.platform platform.node sys.getrecursionlimit
info | prompt | 0 |  | input
notable | setenv | 0 |  | os.putenv os.environ.setdefault
notable | dotenv | 0 |  | dotenv.load_dotenv dotenv.dotenv_values
notable | prompt | 0 | reads a secret from the terminal | getpass.getpass
notable | chdir | 0 |  | os.chdir
notable | setenv | - |  | os.environ.update
notable | unsetenv | 0 | removes an environment variable | os.environ.pop os.unsetenv
notable | syspath | 1 | changes where imports come from | sys.path.insert
notable | syspath | 0 | changes where imports come from | sys.path.append sys.path.extend
notable | limit | 0 | raises the recursion limit | sys.setrecursionlimit
notable | limit | 0 | changes a resource limit | resource.setrlimit
notable | umask | 0 | changes default file permissions | os.umask
notable | aws | - | loads cloud credentials | boto3.Session
caution | unsetenv | - | clears the whole environment | os.environ.clear
caution | keyring | 0 | reads a stored password | keyring.get_password
caution | netrc | - | reads stored credentials | netrc.netrc
""",
    "dynamic": """
caution | eval | 0 | evaluates code built at runtime | eval builtins.eval
caution | exec | 0 | executes code built at runtime | exec builtins.exec
caution | compile | 0 | compiles code built at runtime | compile
caution | import | 0 | imports a module chosen at runtime | __import__ builtins.__import__
caution | unpickle | - | unpickling runs arbitrary code | pickle.loads dill.loads cloudpickle.loads
caution | unpickle | 0 | unpickling runs arbitrary code | pickle.load dill.load cloudpickle.load pickle.Unpickler pandas.read_pickle
caution | unmarshal | - | decodes raw code objects | marshal.loads
caution | yaml | 0 | yaml.load without SafeLoader can construct objects | yaml.load
caution | load | 0 | torch.load unpickles by default | torch.load
caution | dlopen | 0 | loads native code | ctypes.CDLL ctypes.cdll.LoadLibrary ctypes.WinDLL ctypes.PyDLL ctypes.OleDLL ctypes.windll.LoadLibrary
caution | unmarshal | 0 | decodes raw code objects | marshal.load
caution | unpickle | 0 | joblib.load unpickles | joblib.load
caution | yaml | 0 | yaml.unsafe_load can construct arbitrary objects | yaml.unsafe_load
caution | yaml | 0 | yaml.full_load can construct objects | yaml.full_load
caution | yaml | 0 | yaml.load_all without SafeLoader can construct objects | yaml.load_all
caution | run | 0 | executes a file as a script | runpy.run_path
caution | run | 0 | executes a module as a script | runpy.run_module
caution | codeobj | 0 | builds a function from a code object | types.FunctionType
caution | unpickle | 0 | jsonpickle can construct arbitrary objects | jsonpickle.decode
notable | import | 0 |  | importlib.import_module
notable | load | 0 | may unpickle | numpy.lib.format.read_array
notable | reload | 0 | re-executes a module | importlib.reload
notable | import | 1 | imports a file as a module | importlib.util.spec_from_file_location
notable | repl | - | opens an interactive console | code.interact code.InteractiveConsole
notable | debug | - | stops in the debugger | pdb.set_trace breakpoint
info | dlfind | 0 |  | ctypes.util.find_library
info | setattr | 1 | sets an attribute chosen at runtime | setattr
info | atexit | 0 | runs code at interpreter exit | atexit.register
""",
    "stdout": """
info | print | 0 |  | print pprint.pprint rich.print sys.stdout.write
info | warn | 0 |  | sys.stderr.write
info | log | 0 |  | logging.debug logging.info logging.warning logging.error logging.exception
info | progress | - |  | tqdm.tqdm
info | plot | - |  | matplotlib.pyplot.show
""",
    "random": """
info | random | - |  | random.random random.randint random.choice numpy.random.rand numpy.random.randn numpy.random.randint os.urandom
info | shuffle | - |  | random.shuffle
info | sample | - |  | random.sample
info | seed | 0 |  | random.seed numpy.random.seed torch.manual_seed
info | rng | 0 |  | numpy.random.default_rng
info | secret | - |  | secrets.token_hex secrets.token_urlsafe
info | uuid | - |  | uuid.uuid4
""",
    "clock": """
notable | sleep | 0 | blocks for a while | time.sleep
info | now | - |  | time.time datetime.datetime.now
info | clock | - |  | time.perf_counter time.monotonic
info | today | - |  | datetime.date.today
info | sleep | 0 |  | asyncio.sleep
""",
    "concurrency": """
notable | thread | - |  | threading.Thread
notable | pool | 0 |  | multiprocessing.Pool
notable | process | - |  | multiprocessing.Process
notable | pool | - |  | concurrent.futures.ThreadPoolExecutor concurrent.futures.ProcessPoolExecutor
notable | parallel | - |  | joblib.Parallel
info | async | - |  | asyncio.run
info | gather | - |  | asyncio.gather
info | task | - |  | asyncio.create_task
""",
    "exit": """
notable | exit | 0 | ends the process | sys.exit exit quit
caution | exit | 0 | ends the process immediately, skipping cleanup | os._exit
""",
}

#: Methods that tell by their name alone: effect | severity | verb | target | note | methods. Fixed values.
METHODS = """
fs_write | notable | write | 0 |  | .to_csv .to_parquet .to_json .to_excel .to_pickle .to_sql .to_hdf
fs_write | notable | plot | 0 |  | .savefig
fs_write | notable | write | - |  | .write_text .write_bytes
fs_read | info | read | - |  | .read_text .read_bytes
fs_read | info | list | - |  | .iterdir
fs_read | info | glob | 0 |  | .rglob
fs_delete | caution | delete | - | removes a file from disk | .unlink
fs_delete | caution | rmdir | - | removes a directory | .rmdir
"""

#: Fragments of a call's own strings that make it worth reading: needle -> reason. Fixed values.
HAZARDS = {
    "rm -rf": "recursive delete",
    "rm -fr": "recursive delete",
    "sudo ": "elevates privileges",
    "chmod 777": "makes a path world-writable",
    "mkfs": "formats a filesystem",
    "dd if=": "raw device write",
    "| sh": "pipes downloaded content into a shell",
    "| bash": "pipes downloaded content into a shell",
    "curl ": "downloads from the network",
    "wget ": "downloads from the network",
    "/etc/passwd": "reads a system credential file",
    "/etc/shadow": "reads a system credential file",
    ".ssh/": "touches SSH keys",
    ".aws/credentials": "touches cloud credentials",
    "~/.netrc": "touches stored credentials",
    "pip install": "installs packages",
    "apt-get": "changes system packages",
    "git push": "publishes to a remote",
    "--force": "forces an otherwise-refused operation",
}

#: Names that say secret. Fixed values.
SECRET_WORDS = "token secret passw api_key apikey api-key private credential auth cookie session_key access_key client_secret signing _pat bearer".split()

#: Roots of numeric packages, of the standard library, and builtins that no inventory needs. Fixed values.
COMPUTE = """
numpy pandas scipy torch tensorflow jax sklearn statsmodels polars xarray sympy numba cupy dask matplotlib seaborn plotly networkx MDAnalysis mdtraj
Bio openmm ase rdkit
""".split()
STDLIB = """
abc argparse array ast asyncio base64 binascii bisect builtins bz2 calendar cmath cmd collections colorsys concurrent configparser contextlib copy csv
ctypes dataclasses datetime decimal difflib dis email enum errno faulthandler filecmp fileinput fnmatch fractions ftplib functools gc getpass gettext
glob graphlib gzip hashlib heapq hmac html http imaplib importlib inspect io ipaddress itertools json keyword linecache locale logging lzma marshal
math mimetypes mmap multiprocessing netrc numbers operator os pathlib pickle pickletools pkgutil platform plistlib poplib posixpath pprint profile pty
queue quopri random re readline reprlib resource runpy sched secrets select selectors shelve shlex shutil signal site smtplib socket socketserver
sqlite3 ssl stat statistics string stringprep struct subprocess sys sysconfig tarfile tempfile termios textwrap threading time timeit tkinter token
tokenize tomllib trace traceback tracemalloc tty types typing unicodedata unittest urllib uuid venv warnings wave weakref webbrowser wsgiref xml
xmlrpc zipapp zipfile zipimport zlib zoneinfo __future__
""".split()
NOISE = """
len str int float list dict set tuple range enumerate zip sorted isinstance type bool abs min max sum repr format getattr hasattr super
""".split()

#: What a call returns: kind | prefix of a method's path (- for none) | callees. Fixed values.
PRODUCES = """
file | <file> | open io.open gzip.open bz2.open lzma.open codecs.open tempfile.NamedTemporaryFile tempfile.TemporaryFile <path>.open
path | <path> | pathlib.Path pathlib.PurePath pathlib.PosixPath
session | <session> | requests.Session httpx.Client httpx.AsyncClient aiohttp.ClientSession urllib3.PoolManager
response | <response> | requests.get requests.post requests.put requests.patch requests.delete requests.head requests.request httpx.get httpx.post httpx.put httpx.patch httpx.delete httpx.request <session>.get <session>.post <session>.put <session>.patch <session>.delete <session>.request urllib.request.urlopen
process | <proc> | subprocess.run subprocess.Popen asyncio.create_subprocess_exec asyncio.create_subprocess_shell pexpect.spawn
socket | <socket> | socket.socket socket.create_connection
connection | <conn> | sqlite3.connect psycopg2.connect pymysql.connect duckdb.connect sqlalchemy.create_engine <conn>.cursor
archive | <archive> | zipfile.ZipFile tarfile.open tarfile.TarFile
frame | <frame> | pandas.DataFrame pandas.read_csv pandas.read_parquet pandas.read_json pandas.read_excel pandas.read_hdf pandas.read_table pandas.read_sql polars.read_csv polars.DataFrame
array | - | numpy.array numpy.zeros numpy.ones numpy.arange numpy.linspace numpy.empty numpy.load numpy.loadtxt numpy.genfromtxt numpy.asarray numpy.full numpy.eye
tensor | - | torch.tensor torch.zeros torch.ones torch.randn torch.from_numpy torch.load
text | - | str repr format input
number | - | int float len sum abs round min max ord
bool | - | bool isinstance hasattr callable any all
seq | - | list sorted tuple set range enumerate zip map filter reversed glob.glob os.listdir
map | - | dict json.load json.loads collections.Counter collections.defaultdict collections.OrderedDict
"""


def _rows(text: str) -> list[list[str]]:
    return [[c.strip() for c in line.split("|")] for line in text.strip().splitlines()]


def rules() -> list[tuple]:
    """(path, effect, severity, verb, target, note) of each callee."""
    return [(path, effect, sev, verb, target, note or None) for effect, text in RULES.items() for sev, verb, target, note, paths in _rows(text) for path in paths.split()]


def methods() -> list[tuple]:
    """(method, effect, severity, verb, target, note)."""
    return [(name.lstrip("."), effect, sev, verb, target, note or None) for effect, sev, verb, target, note, names in _rows(METHODS) for name in names.split()]


def produces() -> dict[str, str]:
    return {path: kind for kind, _, paths in _rows(PRODUCES) for path in paths.split()}


def prefixes() -> dict[str, str]:
    return {kind: prefix for kind, prefix, _ in _rows(PRODUCES) if prefix != "-"}


_RULE = "path string, effect string, severity string, verb string, target string, note string"


def rule_table(spark: SparkSession) -> DataFrame:
    """Exact rules as a table. Pass a longer one to ``classify`` to add rules."""
    return spark.createDataFrame(rules(), _RULE)


def method_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(methods(), _RULE)


def effect_table(spark: SparkSession) -> DataFrame:
    bar = BARCODE.replace("|", "").split()
    return spark.createDataFrame([(e, i, 1 << i, STAGE[e], bar.index(e)) for i, e in enumerate(EFFECTS)], "effect string, bit int, mask int, stage int, bar int")
