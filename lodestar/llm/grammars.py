"""Bundled grammars, in the notation of ``lalr``. Upper-case names and quoted words are terminals.

They accept every program of their language in common use and stay deliberately wide where only
meaning, not form, decides (cover grammars for parameters, patterns and types).
"""

JSON = "file : value ; value : STR | NUM | WORD | '{' '}' | '{' {pair ','} '}' | '[' ']' | '[' {value ','} ']' ; pair : STR ':' value ;"

_JS = """
file : stmt* ;
stmt : block | ';' | vardecl ';' | expr ';' | 'if' '(' expr ')' stmt | 'if' '(' expr ')' stmt 'else' stmt
  | 'for' 'await'? '(' forhead ')' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'return' expr? ';' | 'break' ID? ';' | 'continue' ID? ';' | 'throw' expr ';' | 'debugger' ';'
  | 'try' block catch? finally? | 'switch' '(' expr ')' '{' case* '}' | ID ':' stmt | function | ASYNC function | class
  | 'import' STR ';' | 'import' {importitem ','} FROM STR ';' | 'export' exported ;
catch : 'catch' block | 'catch' '(' param ')' block ;
finally : 'finally' block ;
case : 'case' expr ':' stmt* | 'default' ':' stmt* ;
block : '{' stmt* '}' ;
importitem : ID | '*' 'as' ID | '{' names? '}' | TYPEWORD importitem ;
names : {name ','} ','? ;
name : word | word 'as' word | TYPEWORD word ;
word : ID | 'default' | STR ;
exported : '{' names? '}' ';' | '{' names? '}' FROM STR ';' | '*' FROM STR ';' | '*' 'as' ID FROM STR ';' | 'default' expr ';' | 'default' function
  | 'default' ASYNC function | 'default' class | vardecl ';' | function | ASYNC function | class TSEXPORT ;
forhead : vardecl ';' expr? ';' expr? | expr? ';' expr? ';' expr? | VAR target 'in' expr | VAR target 'of' expr | expr | expr 'of' expr ;
vardecl : VAR {declarator ','} ;
declarator : target TYPED? | target TYPED? '=' assign ;
target : ID | OBJ props? '}' | '[' elems ']' ;
function : 'function' '*'? ID? TPARAMS? '(' params? ')' TYPED? fbody ;
params : {param ','} ','? ;
param : mods target '?'? TYPED? | mods target '?'? TYPED? '=' assign | '...' target TYPED? ;
mods : MOD* ;
class : 'class' ID? TPARAMS? heritage? CBODY member* '}' ;
heritage : 'extends' unary TARGS? IMPLEMENTS ;
member : ';' | pname+ '?'? TPARAMS? '(' params? ')' TYPED? mbody | pname+ '?'? TYPED? ';' | pname+ '?'? TYPED? '=' assign ';' | 'static' block DECORATED ;
pname : ID | MOD | STR | NUM | '[' assign ']' | '*' | 'static' | ASYNC | 'default' | 'delete' | 'in' | 'of' | 'import' | 'new' | 'return' | 'catch' | 'if' | 'for' | 'this' | 'class' | 'function' | 'typeof' | 'void' | 'export' | 'case' ;
expr : {assign ','} ;
assign : cond | cond '=' assign | cond ASG assign | cond '=>' assign | cond '=>' block | 'yield' '*'? assign | 'yield' ;
cond : bin | bin '?' assign ':' assign ;
bin : unary | bin op unary ;
op : BIN | '*' | '+' | '-' | '<' | '>' | '>' '>' | '>' '>' '>' | '|' | '&' | 'in' ;
unary : postfix | pre unary ;
pre : '!' | '~' | '+' | '-' | INC | 'typeof' | 'void' | 'delete' | 'await' | 'new' | ASYNC ;
postfix : primary | postfix DOT | postfix '?.' ID | postfix '?.' args | postfix '?.' '[' expr ']' | postfix '[' expr ']' | postfix args | postfix TPL | postfix INC TSPOST ;
args : '(' ')' | '(' {item ','} ','? ')' ;
item : assign | '...' assign TSITEM ;
primary : ID | NUM | STR | TPL | 'this' | 'static' | 'of' | 'import' args | 'import' DOT | '[' elems ']' | OBJ props? '}' | args | 'function' '*'? ID? TPARAMS? '(' params? ')' TYPED? block | 'class' ID? heritage? CBODY member* '}' ;
elems : elem | elems ',' elem ;
elem : | assign | '...' assign ;
props : {prop ','} ','? ;
prop : pname+ '(' params? ')' TYPED? block | pname ':' assign | pname | pname '=' assign | '...' assign ;
"""


def _script(types: bool) -> str:
    t = _JS
    if not types:
        for name in ("TSEXPORT", "TSPOST", "TSITEM", "DECORATED", "IMPLEMENTS", "TARGS?", "TPARAMS?", "TYPED?"):
            t = t.replace(" " + name, "")
        t = t.replace(" | TYPEWORD importitem", "").replace(" | TYPEWORD word", "").replace("fbody", "block").replace("mbody", "block").replace("mods target", "target").replace("mods : MOD* ;", "")
        return t.replace("'?'? ", "").replace(" '?'?", "").replace("CBODY", "'{'").replace("pname : ID | MOD", "pname : ID")
    t = t.replace("TSEXPORT", "| tsdecl").replace("stmt : block", "stmt : tsdecl | block").replace("TYPED?", "typed?").replace("TPARAMS?", "tparams?").replace("TARGS?", "targs?").replace("CBODY", "'{'")
    t = t.replace("TSPOST", "| postfix '!' | postfix 'as' type | postfix '[' ']' | postfix targs args").replace("IMPLEMENTS", "implements? | implements").replace("DECORATED", "| '@' postfix member")
    t = t.replace("TSITEM", "typed? | bin typed | bin typed '=' assign | bin '?' typed? | bin '?' typed? '=' assign")
    return t + """
fbody : block | ';' ;
mbody : block | ';' ;
implements : 'implements' {type ','} ;
typed : ':' type ;
tparams : '<' {tparam ','} ','? '>' ;
tparam : ID | ID 'extends' type | ID '=' type | ID 'extends' type '=' type ;
targs : '<' {type ','} '>' ;
tsdecl : 'interface' ID tparams? iext? '{' tmember* '}' | 'type' ID tparams? '=' type ';' | 'enum' ID '{' enums? '}' | VAR 'enum' ID '{' enums? '}' | 'declare' stmt | 'namespace' ID '{' stmt* '}' | 'abstract' class | '@' postfix class ;
iext : 'extends' {type ','} ;
enums : {enumitem ','} ','? ;
enumitem : pname | pname '=' assign ;
tmember : tfield ';' | tfield ',' | tfield ;
tfield : pname+ '?'? typed? | pname+ '?'? tparams? '(' params? ')' typed? | '(' params? ')' typed? ;
type : union | union 'extends' union '?' type ':' type | tfunc ;
tfunc : '(' tplist? ')' '=>' type ;
union : inter | '|' inter | union '|' inter | union '&' inter ;
inter : tprim | inter '[' ']' | inter '[' type ']' | inter 'is' type ;
tprim : tname | tname targs | STR | NUM | '-' NUM | TPL | 'void' | 'this' | 'typeof' tname | 'keyof' inter | '(' tplist? ')' | OBJ tmember* '}' | '{' tmember* '}' | '[' {ttuple ','}? ','? ']' ;
ttuple : type | '...' type ;
tname : ID | tname DOT ;
tplist : {titem ','} ','? ;
titem : type | ID '?'? ':' type | '...' ID ':' type | '...' type ;
"""


JAVASCRIPT, TYPESCRIPT = _script(False), _script(True)

PYTHON = """
file : line* ;
line : NL | stmt ;
stmt : simple | compound ;
simple : {small ';'} ';'? NL ;
small : exprs | exprs AUG exprs | exprs assigned | exprs ':' expr | exprs ':' expr '=' exprs | 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' | 'raise' expr | 'raise' expr 'from' expr
  | 'global' {ID ','} | 'nonlocal' {ID ','} | 'del' exprs | 'assert' expr | 'assert' expr ',' expr | 'import' {modas ','} | 'from' module 'import' imported ;
assigned : '=' exprs | assigned '=' exprs ;
modas : dotted | dotted 'as' ID ;
dotted : ID | dotted DOT ;
module : dots | dotted | dotpath ;
dotpath : DOT | dots DOT | dotpath DOT ;
dots : dot | dots dot ;
dot : '.' | '...' ;
imported : '*' | '(' {nameas ','} ','? ')' | {nameas ','} ;
nameas : ID | ID 'as' ID ;
exprs : {starexpr ','} ','? ;
starexpr : named | '*' expr | 'yield' exprs? | 'yield' 'from' expr ;
named : expr | expr ':=' expr ;
expr : or | or 'if' or 'else' expr | 'lambda' lparams? ':' expr ;
or : unary | or op unary ;
op : BIN | '@' | '/' | '*' | '**' | '-' | '+' | 'in' | 'not' 'in' | 'is' | 'is' 'not' ;
unary : postfix | pre unary ;
pre : 'not' | '-' | '+' | '~' | 'await' ;
postfix : atom | postfix DOT | postfix '.' ID | postfix '(' args? ')' | postfix '[' {sub ','} ','? ']' ;
atom : ID | NUM | STR+ | '...' | '(' ')' | '(' exprs ')' | '(' named comp+ ')' | '[' ']' | '[' exprs ']' | '[' named comp+ ']' | '{' '}' | '{' {entry ','} ','? '}' | '{' entry comp+ '}' ;
entry : named | expr ':' expr | '**' expr | '*' expr ;
comp : 'for' targets 'in' or filter* | 'async' 'for' targets 'in' or filter* ;
filter : 'if' or ;
targets : {target ','} ','? ;
target : postfix | '*' postfix ;
args : {arg ','} ','? ;
arg : named | named comp+ | ID '=' expr | '*' expr | '**' expr ;
sub : named | '*' expr | expr? ':' expr? | expr? ':' expr? ':' expr? ;
lparams : {lparam ','} ','? ;
lparam : ID | ID '=' expr | '*' ID? | '**' ID | '/' ;
compound : 'if' named ':' block elif* else? | 'while' named ':' block else? | for | 'async' for | with | 'async' with | def | 'async' def | deco+ def | deco+ 'async' def | 'try' ':' block except+ else? finally? | 'try' ':' block finally | 'match' exprs ':' NL INDENT matchcase+ DEDENT ;
for : 'for' targets 'in' exprs ':' block else? ;
with : 'with' {withitem ','} ':' block ;
elif : 'elif' named ':' block ;
else : 'else' ':' block ;
finally : 'finally' ':' block ;
except : 'except' ':' block | 'except' '*'? exprs ':' block | 'except' '*'? expr 'as' ID ':' block ;
withitem : expr | expr 'as' target ;
deco : '@' named NL ;
def : 'def' ID tps? '(' params? ')' ':' block | 'def' ID tps? '(' params? ')' '->' expr ':' block | 'class' ID tps? ':' block | 'class' ID tps? '(' args? ')' ':' block ;
tps : '[' {lparam ','} ']' ;
params : {param ','} ','? ;
param : ID annot? | ID annot? '=' expr | '*' | '*' ID annot? | '**' ID annot? | '/' ;
annot : ':' expr | ':' '*' expr ;
block : simple | NL INDENT body+ DEDENT ;
body : stmt | NL ;
matchcase : 'case' pats guard? ':' block | NL ;
pats : {pat ','} ','? | {pat ','} 'as' ID ;
pat : or | '*' or ;
guard : 'if' named ;
"""

GO = """
file : 'package' ID ';' top* ;
top : ';' | import ';' | decl ';' | func ';' ;
import : 'import' ispec | 'import' '(' ispecs ')' ;
ispecs : | ispecs ispec ';' | ispecs ';' ;
ispec : STR | ID STR | '.' STR ;
decl : 'var' vspec | 'var' '(' vspecs ')' | 'const' vspec | 'const' '(' vspecs ')' | 'type' tspec | 'type' '(' tspecs ')' ;
vspecs : | vspecs vspec ';' | vspecs ';' ;
vspec : {ID ','} | {ID ','} type | {ID ','} type '=' exprs | {ID ','} '=' exprs ;
tspecs : | tspecs tspec ';' ;
tspec : ID type | ID '=' type | ID '[' {tparam ','} ']' type ;
tparam : ID | ID constraint ;
constraint : type | '~' type | constraint '|' type | constraint '|' '~' type ;
func : 'func' ID gen? sig body? | 'func' '(' params ')' ID sig body? ;
gen : '[' {tparam ','} ']' ;
sig : '(' params ')' result? ;
result : type | '(' params ')' ;
params : | {param ','} ','? ;
param : type | ID type | ID '...' type | '...' type ;
type : ID | ID DOT | ID '[' {type ','} ']' | ID DOT '[' {type ','} ']' | '*' type | '[' ']' type | '[' expr ']' type | '[' '...' ']' type | 'map' '[' type ']' type | 'chan' type | ARROW 'chan' type | 'chan' ARROW type | 'func' sig
  | 'struct' brace fields '}' | 'interface' brace methods '}' | '(' type ')' ;
brace : '{' | LIT ;
fields : | fields field ';' | fields ';' | fields field ;
field : {ID ','} type STR? | ID STR? | ID DOT STR? | '*' ID STR? | '*' ID DOT STR? ;
methods : | methods method ';' | methods ';' | methods method ;
method : ID sig | constraint ;
body : '{' stmts '}' ;
stmts : stmt | stmts ';' stmt ;
stmt : | decl | simple | 'return' exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | 'go' expr | 'defer' expr | body | if | 'for' fhead body | 'switch' shead '{' cases '}' | 'select' '{' cases '}' | ID ':' stmt ;
simple : exprs | exprs ASG exprs | exprs '=' exprs | exprs ':=' exprs | expr INC | expr ARROW expr | exprs ':=' 'range' expr | exprs '=' 'range' expr ;
if : 'if' head body | 'if' head body 'else' if | 'if' head body 'else' body ;
head : simple | simple ';' simple | ';' simple ;
fhead : | simple | simple? ';' simple? ';' simple? | 'range' expr ;
shead : | simple | simple? ';' simple? ;
cases : | cases case ;
case : 'case' citems ':' stmts | 'default' ':' stmts ;
citems : simple | typelist ;
typelist : basictype | typelist ',' basictype | exprs ',' basictype ;
basictype : '[' ']' type | 'map' '[' type ']' type | 'struct' brace fields '}' | 'interface' brace methods '}' | 'chan' type ;
exprs : {expr ','} ;
expr : unary | expr op unary ;
op : BIN | '*' | '+' | '-' | '&' | '|' | '^' ;
unary : primary | pre unary ;
pre : '+' | '-' | '!' | '^' | '*' | '&' | ARROW | '~' ;
primary : operand | primary DOT | primary '.' '(' type ')' | primary '.' '(' 'type' ')' | primary '[' {index ','} ','? ']' | primary '(' ')' | primary '(' {arg ','} ','? ')' | primary LIT elems '}' ;
index : expr | expr? ':' expr? | expr? ':' expr ':' expr | basictype ;
arg : expr | expr '...' | basictype ;
operand : ID | NUM | STR | '(' expr ')' | '(' basictype ')' | 'func' sig body | basictype LIT elems '}' | '[' '...' ']' type LIT elems '}' | '[' expr ']' type LIT elems '}' | basictype '(' expr ')' ;
elems : | {elem ','} ','? ;
elem : val | val ':' val ;
val : expr | LIT elems '}' | '{' elems '}' ;
"""

RUST = """
file : inner* item* ;
inner : '#' '!' '[' tt* ']' ;
attr : '#' '[' tt* ']' ;
item : attr item | vis plain | plain ;
vis : 'pub' | 'pub' '(' tt+ ')' ;
plain : 'use' usetree ';' | 'mod' ID ';' | 'mod' ID '{' item* '}' | fn | 'struct' ID gen? where? sbody | 'enum' ID gen? where? '{' {variant ','}? ','? '}' | 'union' ID gen? '{' sfields '}'
  | impl gen? type where? '{' item* '}' | impl gen? '!'? type 'for' type where? '{' item* '}' | trait ID gen? bounds? where? '{' item* '}'
  | 'const' ID ':' type '=' expr ';' | 'const' ID ':' type ';' | 'static' 'mut'? ID ':' type '=' expr ';' | 'type' ID gen? bounds? where? ';' | 'type' ID gen? where? '=' type ';' | 'extern' 'crate' ID ';' | 'extern' STR? '{' item* '}'
  | macro ';' | bracemacro ;
impl : 'impl' | 'unsafe' 'impl' ;
trait : 'trait' | 'unsafe' 'trait' ;
macro : path '!' '(' tt* ')' | path '!' '[' tt* ']' ;
bracemacro : path '!' ID? brace tt* '}' ;
brace : '{' | LIT ;
usetree : path | path 'as' ID | path '::' '*' | path '::' brace usetrees '}' | '::' usetree | brace usetrees '}' | '*' ;
usetrees : | {usetree ','} ','? ;
path : seg | path '::' seg | path '::' targs | '::' seg ;
seg : ID | 'self' | 'super' | 'crate' ;
fn : 'fn' ID gen? '(' params ')' ret? where? fnbody | fnmods1 'fn' ID gen? '(' params ')' ret? where? fnbody ;
fnmods1 : fnmod | fnmods1 fnmod ;
fnmod : 'const' | 'unsafe' | 'async' | 'extern' STR? ;
fnbody : ';' | block ;
ret : '->' type ;
params : | {param ','} ','? ;
param : attr? selfparam | attr? pattern ':' type ;
fnargs : | {fnarg ','} ','? ;
fnarg : type | ID ':' type | '_' ':' type ;
selfparam : 'mut'? 'self' | '&' LIFE? 'mut'? 'self' | 'mut'? 'self' ':' type ;
gen : '<' {gparam ','}? ','? '>' ;
gparam : LIFE | LIFE ':' {LIFE '+'} | ID bounds? | ID bounds? '=' type | 'const' ID ':' type ;
bounds : ':' | ':' {bound '+'} ;
bound : LIFE | '?'? ptype | forlife ptype ;
forlife : 'for' '<' {LIFE ','} '>' ;
where : 'where' {wclause ','} ','? ;
wclause : type bounds | LIFE bounds ;
sbody : ';' | '(' tfields ')' where? ';' | '{' sfields '}' | LIT sfields '}' ;
tfields : | {tfield ','} ','? ;
tfield : attr* vis? type ;
sfields : | {sfield ','} ','? ;
sfield : attr* vis? ID ':' type ;
variant : attr* ID | attr* ID '(' tfields ')' | attr* ID '{' sfields '}' | attr* ID LIT sfields '}' | attr* ID '=' expr ;
type : ptype | '&' LIFE? 'mut'? type | '&&' LIFE? 'mut'? type | '*' 'const' type | '*' 'mut' type | '[' type ']' | '[' type ';' expr ']' | '(' ')' | '(' {type ','} ','? ')' | '!' | '_' | 'impl' {bound '+'} | 'dyn' {bound '+'} | 'fn' '(' fnargs ')' ret? | LIFE ;
ptype : tseg | ptype '::' tseg | '::' tseg | '<' type '>' '::' tseg | '<' type 'as' type '>' '::' tseg ;
tseg : seg | seg targs | seg '::' targs | seg '(' {type ','}? ')' ret? ;
targs : '<' {targ ','}? ','? '>' ;
targ : type | NUM | ID '=' type | '{' expr '}' ;
block : '{' stmt* '}' | '{' stmt* tail '}' ;
stmt : ';' | attr stmt | vis plain | plain | let | stmtexpr ';' | blocklike ;
stmtexpr : expr ;
tail : expr ;
let : 'let' pattern typed? ';' | 'let' pattern typed? '=' expr ';' | 'let' pattern typed? '=' expr 'else' block ';' ;
typed : ':' type ;
blocklike : block | 'unsafe' block | 'async' 'move'? block | 'loop' block | 'while' cond block | 'for' pattern 'in' expr block | label 'loop' block | label 'while' cond block | label 'for' pattern 'in' expr block | label block | if | 'match' expr '{' arms '}' ;
label : LIFE ':' ;
if : 'if' cond block | 'if' cond block 'else' block | 'if' cond block 'else' if ;
cond : expr ;
arms : | arms arm ;
arm : attr arm | pattern guard? '=>' blocklike ','? | pattern guard? '=>' expr ',' | pattern guard? '=>' expr ;
guard : 'if' expr ;
pattern : '|'? {pat '|'} ;
pat : pprim | pprim '..' pprim | pprim '..' | '..' pprim | '..' ;
pprim : path | path targs | lit | 'ref' 'mut'? ID | 'mut' ID | ID '@' pprim | '_' | '&' 'mut'? pprim | '&&' pprim | '(' {pattern ','}? ','? ')' | '[' {pattern ','}? ','? ']' | path '(' {pattern ','}? ','? ')' | path LIT {fpat ','}? ','? '}' | path '{' {fpat ','}? ','? '}' | macro ;
fpat : ID ':' pattern | 'ref'? 'mut'? ID | '..' ;
lit : NUM | STR | '-' NUM ;
expr : range | range '=' expr | range ASG expr | 'return' expr? | 'break' LIFE? expr? | 'continue' LIFE? | closure ;
closure : 'move'? '|' {cparam ','}? '|' expr | 'move'? '|' {cparam ','}? '|' ret block | 'move'? OROR expr ;
cparam : pat typed? ;
range : bin | bin '..' bin | bin '..' | '..' bin | '..' ;
bin : unary | bin op unary | bin 'as' type | 'let' pattern '=' unary ;
op : BIN | OROR | '&&' | '*' | '+' | '-' | '&' | '|' | '<' | '>' | '>' '>' ;
unary : postfix | pre unary ;
pre : '-' | '!' | '*' | '&' 'mut'? | '&&' ;
postfix : primary | postfix DOT | postfix DOT '::' targs | postfix '(' {expr ','}? ','? ')' | postfix '[' expr ']' | postfix '?' ;
primary : lit0 | path | macro | bracemacro | '(' ')' | '(' {expr ','} ','? ')' | '[' ']' | '[' {expr ','} ','? ']' | '[' expr ';' expr ']' | path LIT {finit ','}? ','? '}' | blocklike | '<' type '>' '::' seg | '<' type 'as' type '>' '::' seg ;
lit0 : NUM | STR | LIFE ;
finit : ID ':' expr | ID | '..' expr | '..' ;
tt : ID | NUM | STR | LIFE | DOT | '(' tt* ')' | '[' tt* ']' | '{' tt* '}' | LIT tt* '}' | ',' | ';' | ':' | '::' | '=' | '=>' | '->' | '..' | '#' | '!' | '?' | '@' | '_' | '$' | ASG | BIN | OROR | '&&' | '*' | '+' | '-' | '&' | '|' | '<' | '>' | KW ;
"""

BASH = """
file : NL* list? ;
list : andor | list sep andor | list sep ;
sep : ';' | '&' | NL | sep NL ;
andor : pipe | andor AND NL* pipe ;
pipe : command | '!' pipe | pipe '|' NL* command ;
command : simple | compound redirect* | function ;
function : WORD '(' ')' NL* compound redirect* | 'function' WORD NL* compound | 'function' WORD '(' ')' NL* compound ;
simple : first | simple arg | simple redirect | redirect ;
first : WORD | ARR words ')' | COND ;
arg : WORD | ARR words ')' | COND | 'if' | 'then' | 'else' | 'elif' | 'fi' | 'for' | 'in' | 'do' | 'done' | 'while' | 'until' | 'case' | 'esac' | 'function' | 'select' | '!' | '{' | '}' ;
words : | words arg | words NL ;
redirect : REDIR arg ;
compound : '{' NL* list '}' | '(' NL* list ')' | ARITH | COND | 'if' clist 'then' clist elifs? 'fi' | loop clist 'do' clist 'done' | each NL* 'do' clist 'done' | each ';' NL* 'do' clist 'done' | 'for' ARITH ';'? NL* 'do' clist 'done' | 'case' arg NL* 'in' NL* items 'esac' ;
clist : NL* list ;
elifs : 'elif' clist 'then' clist elifs | 'elif' clist 'then' clist | 'else' clist ;
loop : 'while' | 'until' ;
each : 'for' WORD | 'for' WORD NL* 'in' each2 | 'select' WORD 'in' each2 ;
each2 : | each2 arg ;
items : | items item | items lastitem ;
item : '('? {arg '|'} ')' NL* list? DSEMI NL* ;
lastitem : '('? {arg '|'} ')' NL* list ;
"""

TOML = """
file : NL* line* ;
line : '[' key ']' NL+ | TABLES key ']' ']' NL+ | key '=' value NL+ ;
key : {part '.'} ;
part : BARE | STR | NUM ;
value : STR | NUM | BARE | '[' NL* elems ']' | '{' pairs '}' ;
elems : | {value elemsep} NL* | {value elemsep} elemsep ;
elemsep : NL* ',' NL* ;
pairs : | {pair ','} ;
pair : key '=' value ;
"""

YAML = """
file : docs ;
docs : doc | docs SEP doc ;
doc : | node ;
node : OPEN items CLOSE ;
items : mapitem+ | dashitem+ | scalar ;
scalar : VALUE+ | PROP+ VALUE* | BLOCKTEXT | flow ;
mapitem : KEY rest ;
rest : | PROP+ | val | PROP+ val | dashitem+ | PROP+ dashitem+ ;
val : VALUE+ | BLOCKTEXT | flow | node ;
dashitem : DASH rest2 ;
rest2 : | PROP+ | val | PROP+ val ;
flow : '[' fitems ']' | '{' fitems '}' ;
fitems : | {fitem ','} | {fitem ','} ',' ;
fitem : fnode | fnode ':' fnode | fnode ':' ;
fnode : FSCALAR | flow | PROP fnode ;
"""
