"""Grammars in the notation of ``derivatives.Grammar``, written from the public language definitions.

Precedence of operators does not matter for validity, so expressions are flat: operands joined by operators.
None is left-recursive, and what two readings share is written once: a choice that stays open inside brackets would
double the state with every level of nesting. What stands left of an assignment is read as an expression where it
may hold brackets. Where a language has one text with two readings (targets and expressions, arrow
parameters and parentheses, types and comparisons) both are kept until one fails.
"""

from __future__ import annotations

from functools import lru_cache

from codestrata.llm.derivatives import Grammar

JSON = """
file: value
value: STR | NUM | 'true' | 'false' | 'null' | '{' (member (',' member)*)? '}' | '[' (value (',' value)*)? ']'
member: STR ':' value
"""

TOML = """
file: NL* (line NL+)* line?
line: key '=' value | '[' key ']' | '[[' key ']]'
key: part ('.' part)*
part: KEY | STR
value: STR | MLSTR | SCALAR | '[' NL* (value NL* (',' NL* value NL*)* (',' NL*)?)? ']' | '{' (key '=' value (',' key '=' value)*)? '}'
"""

YAML = """
file: DIRECTIVE* node? (DOCEND* DIRECTIVE* DOCSTART node?)* DOCEND*
node: props? (blockseq | blockmap | flow | SCALAR | BLOCKSCALAR) | ALIAS | props
props: (TAG | ANCHOR)+
blockseq: SEQSTART (ENTRY node?)+ END
blockmap: MAPSTART ((KEY value?)? VALUE value? | KEY value?)+ END
value: node | props? (ENTRY node?)+
flow: '[' (flowentry (',' flowentry)* ','?)? ']' | '{' (flowentry (',' flowentry)* ','?)? '}'
flownode: props? (flow | SCALAR) | ALIAS | props
flowentry: flownode | KEY flownode? (VALUE flownode?)? | VALUE flownode?
"""

PYTHON = """
file: (NEWLINE | stmt)*
stmt: compound | simpleline
simpleline: simple (';' simple)* ';'? NEWLINE
simple: assignment | starexprs | 'return' starexprs? | import | 'raise' (expr ('from' expr)?)? | 'pass' | 'del' targets
  | yieldexpr | 'assert' expr (',' expr)? | 'break' | 'continue' | 'global' ident (',' ident)* | 'nonlocal' ident (',' ident)*
  | 'type' ident typeparams? '=' expr
assignment: (targets '=')+ (yieldexpr | starexprs) | target (AUG (yieldexpr | starexprs) | ':' expr ('=' (yieldexpr | starexprs))?)
targets: startarget (',' startarget)* ','?
startarget: '*'? target
target: ident | group | atom trailer* ('.' ident | '[' slices ']')
group: '(' (yieldexpr | starnamed (compfor | (',' starnamed)* ','?))? ')' | '[' (starnamed (compfor | (',' starnamed)* ','?))? ']'
import: 'import' dotted ('as' ident)? (',' dotted ('as' ident)?)* | 'from' ('.' | '...')* dotted 'import' imported | 'from' ('.' | '...')+ 'import' imported
imported: '*' | '(' names ','? ')' | names
names: ident ('as' ident)? (',' ident ('as' ident)?)*
dotted: ident ('.' ident)*
compound: 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)? | 'while' named ':' block ('else' ':' block)? | for | with
  | 'try' ':' block (except+ ('else' ':' block)? | exceptstar+ ('else' ':' block)?)? finally? | 'async' (for | with | funcdef) | match
  | decorator* (classdef | funcdef | 'async' funcdef)
for: 'for' targets 'in' starexprs ':' block ('else' ':' block)?
with: 'with' (withitem (',' withitem)* | '(' withitem (',' withitem)* ','? ')') ':' block
withitem: expr ('as' startarget)?
except: 'except' (expr ('as' ident)?)? ':' block
exceptstar: 'except' '*' expr ('as' ident)? ':' block
finally: 'finally' ':' block
decorator: '@' named NEWLINE
classdef: 'class' ident typeparams? ('(' args? ')')? ':' block
funcdef: 'def' ident typeparams? '(' params? ')' ('->' expr)? ':' block
typeparams: '[' typeparam (',' typeparam)* ','? ']'
typeparam: ident (':' expr)? ('=' expr)? | '*' ident ('=' starexpr)? | '**' ident ('=' expr)?
block: NEWLINE INDENT stmt+ DEDENT | simpleline
params: pn (',' (params | '/' (',' params?)?)?)? | pd (',' (pdefaults | '/' (',' pdefaults?)?)?)? | prest
pdefaults: pd (',' (pdefaults | '/' (',' pdefaults?)?)?)? | prest
prest: '*' ident (':' starexpr)? (',' pkw?)? | '*' ',' pkw | '**' pn ','?
pkw: (pn | pd) (',' pkw?)? | '**' pn ','?
pn: ident (':' expr)?
pd: ident (':' expr)? '=' expr
match: 'match' subject ':' NEWLINE INDENT case+ DEDENT
subject: starnamed (',' starnamed)* ','?
case: 'case' patterns ('if' named)? ':' block
patterns: starpattern (',' starpattern)* ','?
starpattern: '*' ident | aspattern
aspattern: orpattern ('as' ident)?
orpattern: pattern ('|' pattern)*
pattern: '-'? NUM (('+' | '-') NUM)? | strings | 'None' | 'True' | 'False' | ident ('.' ident)* ('(' patargs? ')')? | '(' patterns? ')' | '[' patterns? ']'
  | '{' (patitem (',' patitem)* ','?)? '}'
patargs: patarg (',' patarg)* ','?
patarg: aspattern | ident '=' aspattern
patitem: ('-'? NUM (('+' | '-') NUM)? | strings | 'None' | 'True' | 'False' | ident ('.' ident)+) ':' aspattern | '**' ident
yieldexpr: 'yield' ('from' expr | starexprs)?
starexprs: starexpr (',' starexpr)* ','?
starexpr: '*' bitor | expr
starnamed: '*' bitor | named
named: ident ':=' expr | expr
expr: disj ('if' disj 'else' expr)? | lambda
lambda: 'lambda' lparams? ':' expr
lparams: ident (',' (lparams | '/' (',' lparams?)?)?)? | ident '=' expr (',' (ldefaults | '/' (',' ldefaults?)?)?)? | lrest
ldefaults: ident '=' expr (',' (ldefaults | '/' (',' ldefaults?)?)?)? | lrest
lrest: '*' ident (',' lkw?)? | '*' ',' lkw | '**' ident ','?
lkw: ident ('=' expr)? (',' lkw?)? | '**' ident ','?
disj: notx (('and' | 'or') notx)*
notx: 'not'* comparison
comparison: bitor (compop bitor)*
compop: COMP | 'in' | 'not' 'in' | 'is' 'not'?
bitor: unary (binop unary)*
binop: BIN | '*' | '**' | '+' | '-' | '|' | '@' | '/'
unary: ('+' | '-' | '~')* 'await'? atom trailer*
trailer: '.' ident | '(' args? ')' | '[' slices ']'
slices: slice (',' slice)* ','?
slice: ':' expr? (':' expr?)? | named (':' expr? (':' expr?)?)? | '*' bitor
args: posarg (compfor | (',' posarg)* (',' kwargs)? ','?) | kwargs ','?
posarg: '*' expr | named
kwargs: (kw | '*' expr) (',' (kw | '*' expr))* (',' (kw | '**' expr))* | (kw | '**' expr) (',' (kw | '**' expr))*
kw: ident '=' expr
atom: ident | NUM | strings | 'None' | 'True' | 'False' | '...' | group
  | '{' (dictitem (compfor | (',' dictitem)* ','?) | starnamed (compfor | (',' starnamed)* ','?))? '}'
dictitem: expr ':' expr | '**' bitor
compfor: ('async'? 'for' targets 'in' disj ('if' (disj | lambda))*)+
strings: (STR | fstring)+ | BYTES+
fstring: FSTART (FOPEN (yieldexpr | starexprs) CONV? FSPEC? FCLOSE)* FEND
ident: NAME | 'match' | 'case' | 'type' | '_'
"""

_ECMA = """
file: HASHBANG? item*
item: import | export | stmt
term: ';' | ASI
block: '{' stmt* '}'
stmt: block | declaration | ';' | exprstmt | if | for | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'? | 'continue' ident? term
  | 'break' ident? term | 'return' expr? term | 'throw' expr term | switch | try | 'debugger' term | ident ':' stmt | 'with' '(' expr ')' stmt
declaration: ('var' | 'let' | 'const') binding (',' binding)* term | function | class @DECL
exprstmt: expr_s term
if: 'if' '(' expr ')' stmt ('else' stmt)?
for: 'for' 'await'? '(' forhead ')' stmt
forhead: ('var' | 'let' | 'const') (binding_nv (',' binding_nv)* ';' expr? ';' expr? | (ident | pattern) ('of' assign | 'in' expr))
  | ';' expr? ';' expr? | expr_f (';' expr? ';' expr? | 'of' assign)?
expr_f: assign_b (',' assign)* | '{' (prop (',' prop)* ','?)? '}'
switch: 'switch' '(' expr ')' '{' ('case' expr ':' stmt* | 'default' ':' stmt*)* '}'
try: 'try' block ('catch' ('(' (ident | pattern) @ANN? ')')? block ('finally' block)? | 'finally' block)
binding: (ident | pattern) @BANG? @ANN? ('=' assign)?
binding_nv: (ident | pattern) @ANN? ('=' assign)?
pattern: '{' (propbind (',' propbind)* ','? | (propbind ',')* '...' (ident | pattern) ','?)? '}' | '[' ','* (elembind (','+ elembind)* ','*)? ('...' (ident | pattern))? ']'
propbind: ident ('=' assign)? | propname ':' (ident | pattern) ('=' assign)?
elembind: (ident | pattern) ('=' assign)?
params: param (',' param)* (',' rest)? ','? | rest
param: @PMOD (ident | pattern | @THIS) @OPT @ANN? ('=' assign)?
rest: '...' (ident | pattern) @ANN?
function: 'async'? 'function' '*'? ident @TPAR? '(' params? ')' @RET? fbody | 'async'? 'function' '*'? @TPAR? '(' params? ')' @RET? fbody
fbody: '{' stmt* '}' @NOBODY
class: @DECOR 'class' classname? @TPAR? ('extends' chain @TARGS?)? @IMPL '{' (member | ';')* '}'
classname: ident
member: @DECOR @CMOD* (@MEMBERS | method | field)
method: ('async' | 'get' | 'set')? '*'? membername @OPT @TPAR? '(' params? ')' @RET? mbody | 'async' '*' membername @TPAR? '(' params? ')' @RET? mbody
mbody: '{' stmt* '}' @MNOBODY
field: membername @FOPT @ANN? ('=' assign)? term | 'static' block
membername: propname | PRIVATE
propname: anyname | STR | NUM | '[' assign ']'
import: 'import' @ITYPE (importclause 'from')? STR term @IMPORTS
importclause: ident (',' (namedimports | '*' 'as' ident))? | namedimports | '*' 'as' ident
namedimports: '{' (importspec (',' importspec)* ','?)? '}'
importspec: @ITYPE1 ((anyname | STR) 'as')? ident
export: 'export' (@ITYPE ('*' ('as' (anyname | STR))? 'from' STR term | '{' (exportspec (',' exportspec)* ','?)? '}' ('from' STR)? term) | declaration
  | 'default' (function | class | expr_s term @DEFAULTS) @EXPORTS)
exportspec: @ITYPE1 (anyname | STR) ('as' (anyname | STR))?
expr: assign (',' assign)*
expr_s: assign_s (',' assign)*
assign: arrow | 'yield' ('*'? assign)? | cond ((ASSIGN | '=') assign)?
assign_s: arrow | 'yield' ('*'? assign)? | cond_s ((ASSIGN | '=') assign)?
assign_b: arrow | 'yield' ('*'? assign)? | cond_b ((ASSIGN | '=') assign)?
arrow: 'async'? (ident | @TPAR? '(' params? ')' @RET?) '=>' ('{' stmt* '}' | assign_b)
cond: binary ('?' assign ':' assign)?
cond_s: binary_s ('?' assign ':' assign)?
cond_b: binary_b ('?' assign ':' assign)?
binary: unary (binop unary @AS)*
binary_s: unary_s @AS (binop unary @AS)*
binary_b: unary_b @AS (binop unary @AS)*
binop: BIN | '*' | '+' | '-' | '/' | 'in' | 'instanceof' | '<' | '>' | '>' '>' | '>' '>' '>' | '>' '>=' | '>=' | '&' | '|' @BINOP
unary: prefix* postfix @AS | PRIVATE 'in' unary
unary_s: prefix+ postfix @AS | postfix_s
unary_b: prefix+ postfix @AS | postfix_b
prefix: '!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' @CAST
postfix: chain ('++' | '--')?
postfix_s: chain_s ('++' | '--')?
postfix_b: chain_b ('++' | '--')?
chain: primary suffix*
chain_s: primary_s suffix*
chain_b: primary_b suffix*
suffix: '.' (anyname | PRIVATE) | '?.' (anyname | PRIVATE | '[' expr ']' | @TARGS? '(' args? ')') | '[' expr ']' | @TARGS? '(' args? ')' | template @SUFFIX
args: arg (',' arg)* ','?
arg: '...'? assign
primary: primary_s | '{' (prop (',' prop)* ','?)? '}' | function | class
primary_s: ident | NUM | STR | REGEX | 'this' | 'null' | 'true' | 'false' | 'super' | template | '(' expr ')' | '[' ','* (arg (','+ arg)* ','*)? ']'
  | 'new' (newtarget | '.' anyname) | 'import' ('(' assign (',' assign)? ','? ')' | '.' anyname)
primary_b: primary_s | function | class
newtarget: newchain (@TARGS? '(' args? ')')? @NEWARGS
newchain: 'new'* newprimary ('.' (anyname | PRIVATE) | '[' expr ']' | template)*
newprimary: ident | 'this' | 'super' | function | class | '(' expr ')' | 'new' '.' anyname | 'import' '.' anyname | '[' ','* (arg (','+ arg)* ','*)? ']' | STR
prop: ident ('=' assign)? | propname ':' assign | '...' assign | pmethod
pmethod: ('async' | 'get' | 'set')? '*'? propname @TPAR? '(' params? ')' @RET? '{' stmt* '}' | 'async' '*' propname @TPAR? '(' params? ')' @RET? '{' stmt* '}'
template: TEMPLATE | THEAD expr (TMIDDLE expr)* TTAIL
"""

_JS_RESERVED = (
    "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null "
    "return super switch this throw true try typeof var void while with"
).split()
_JS_SOFT = "async get set of let static from as await yield".split()
_TS_SOFT = (
    "type interface enum namespace module declare readonly public private protected abstract implements keyof infer unique is asserts override "
    "satisfies any unknown never string number boolean symbol object bigint global require out accessor undefined"
).split()
#: ``enum`` is reserved in JavaScript; the strict-mode words stay usable as names in scripts.
_JS_STRICT = "implements interface package private protected public".split()

_JS_HOLES = dict.fromkeys(
    "DECL ANN BANG PMOD THIS OPT TPAR RET NOBODY DECOR TARGS IMPL CMOD MEMBERS MNOBODY FOPT ITYPE IMPORTS ITYPE1 DEFAULTS EXPORTS AS BINOP CAST SUFFIX SUF0 "
    "NEWARGS".split()
) | {"CMOD": "'static'"}
_TS_HOLES = {
    "DECL": "| interface | typealias | enum | namespace | 'declare' declaration | 'declare' 'global' block | 'abstract' class | 'declare' namespace | importeq",
    "ANN": "(':' type)",
    "BANG": "'!'",
    "PMOD": "decorator* ('public' | 'private' | 'protected' | 'readonly' | 'override')*",
    "THIS": "'this'",
    "OPT": "'?'?",
    "TPAR": "tparams",
    "RET": "(':' rettype)",
    "NOBODY": "| term",
    "DECOR": "decorator* 'abstract'?",
    "TARGS": "targs",
    "IMPL": "('implements' typeref (',' typeref)*)?",
    "CMOD": "('public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'static' | 'override' | 'declare' | 'accessor')",
    "MEMBERS": "indexsig term",
    "MNOBODY": "| term",
    "FOPT": "('?' | '!')?",
    "ITYPE": "'type'?",
    "IMPORTS": "| importeq",
    "ITYPE1": "'type'?",
    "DEFAULTS": "| interface | 'abstract' class",
    "EXPORTS": "| '=' expr term | 'as' 'namespace' ident term | importeq | interface",
    "AS": "(('as' | 'satisfies') (type | 'const'))*",
    "BINOP": "",
    "CAST": "| '<' (type | 'const') '>'",
    "SUFFIX": "| '!' | targs",
    "SUF0": "'!'*",
    "NEWARGS": "| newchain targs",
}
_TS_TYPES = """
tparams: ('<' | LTYPE) tparam (',' tparam)* ','? '>'
tparam: ('const' | 'in' | 'out')* ident ('extends' type)? ('=' type)?
targs: ('<' | LTYPE) type (',' type)* '>'
rettype: type | 'asserts'? (ident | 'this') 'is' type | 'asserts' (ident | 'this')
type: 'abstract'? 'new' tparams? '(' tyargs? ')' '=>' type | tparams? '(' tyargs? ')' '=>' rettype | union ('extends' type '?' type ':' type)?
tyargs: tyarg (',' tyarg)* ','?
tyarg: '...'? (ident | pattern | 'this') '?'? (':' type)?
union: '|'? inter ('|' inter)*
inter: '&'? tunary ('&' tunary)*
tunary: ('keyof' | 'unique' | 'readonly')* tpostfix | 'infer' ident ('extends' type)?
tpostfix: tprimary ('[' type? ']')*
tprimary: typeref | STR | NUM | '-' NUM | 'null' | 'true' | 'false' | 'this' | 'void' | 'typeof' (typeref | 'import' '(' STR ')' ('.' anyname)* targs?) | '(' type ')'
  | '{' tmembers '}' | '[' (tuple (',' tuple)* ','?)? ']' | TEMPLATE | THEAD type (TMIDDLE type)* TTAIL | 'import' '(' STR ')' ('.' anyname)* targs?
typeref: (ident | 'this') ('.' anyname)* targs?
tuple: '...'? (anyname '?'? ':' type | type '?'?)
tmembers: mapped | (tmember (tsep+ tmember)* tsep*)?
tsep: ';' | ',' | ASI
mapped: (('+' | '-')? 'readonly')? '[' ident 'in' type ('as' type)? ']' (('+' | '-')? '?')? (':' type)? (';' | ASI)?
tmember: ('readonly' | 'get' | 'set')* propname '?'? (':' type)? | ('get' | 'set')? propname '?'? tparams? '(' tyargs? ')' (':' rettype)?
  | 'new'? tparams? '(' tyargs? ')' (':' rettype)? | indexsig
indexsig: ('readonly' | 'static')* '[' ident ':' type ']' (':' type)?
interface: 'interface' ident tparams? ('extends' typeref (',' typeref)*)? '{' tmembers '}'
typealias: 'type' ident tparams? '=' type term
enum: 'const'? 'enum' ident '{' (enumitem (',' enumitem)* ','?)? '}'
enumitem: propname ('=' assign)?
namespace: ('namespace' | 'module') (ident ('.' ident)* | STR) ('{' item* '}' | term)
importeq: 'import' 'type'? ident '=' ('require' '(' STR ')' | ident ('.' anyname)*) term
decorator: '@' (ident | '(' expr ')') ('.' anyname | targs? '(' args? ')')*
"""

JAVA = """
file: package? ';'* (import ';'*)* (typedecl ';'* | module)*
package: annotation* 'package' qualified ';'
import: 'import' 'static'? qualified ('.' '*')? ';'
module: annotation* 'open'? 'module' qualified '{' directive* '}'
directive: 'requires' ('transitive' | 'static')* qualified ';' | ('exports' | 'opens') qualified ('to' qualified (',' qualified)*)? ';' | 'uses' qualified ';'
  | 'provides' qualified 'with' qualified (',' qualified)* ';'
qualified: ident ('.' ident)*
annotation: '@' qualified ('(' (annvalue | ident '=' annvalue (',' ident '=' annvalue)*)? ')')?
annvalue: cond | annotation | '{' (annvalue (',' annvalue)*)? ','? '}'
modifier: annotation | 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp'
  | 'default' | 'sealed' | 'non' '-' 'sealed'
typedecl: modifier* (class | enum | interface | record | anntype)
class: 'class' ident tparams? ('extends' type)? ('implements' types)? ('permits' types)? classbody
enum: 'enum' ident ('implements' types)? '{' (constant (',' constant)*)? ','? (';' member*)? '}'
constant: annotation* ident ('(' args? ')')? classbody?
interface: 'interface' ident tparams? ('extends' types)? ('permits' types)? classbody
record: 'record' ident tparams? '(' (component (',' component)*)? ')' ('implements' types)? classbody
component: annotation* type '...'? ident
anntype: '@' 'interface' ident classbody
classbody: '{' member* '}'
member: ';' | 'static'? block | modifier* (class | enum | interface | record | anntype | tparams? (type | 'void') ident methodrest | tparams? ident methodrest
  | type declarator (',' declarator)* ';' | tparams? ident block)
methodrest: '(' params? ')' dims ('throws' types)? (block | 'default' annvalue ';' | ';')
params: param (',' param)*
param: pmod* type (annotation* '...')? (ident dims | (ident '.')? 'this')
pmod: annotation | 'final'
tparams: '<' tparam (',' tparam)* '>'
tparam: annotation* ident ('extends' type ('&' type)*)?
types: type (',' type)*
type: annotation* (PRIM | ident targs? ('.' annotation* ident targs?)*) dims
dims: (annotation* '[' ']')*
targs: '<' (targ (',' targ)*)? '>'
targ: type | annotation* '?' (('extends' | 'super') type)?
declarator: ident dims ('=' init)?
init: expr | '{' (init (',' init)*)? ','? '}'
block: '{' blockstmt* '}'
blockstmt: local ';' | modifier* (class | interface | enum | record) | stmt
local: pmod* type declarator (',' declarator)*
stmt: block | ';' | stmtexpr ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | for | switch
  | 'return' expr? ';' | 'break' ident? ';' | 'continue' ident? ';' | 'throw' expr ';' | 'synchronized' '(' expr ')' block | try | ident ':' stmt
  | 'assert' expr (':' expr)? ';' | 'yield' expr ';'
stmtexpr: ('++' | '--') unary | chain ((ASSIGN | '=' | '>' '>=' | '>' '>' '>=') expr | '++' | '--')?
for: 'for' '(' ((local | stmtexpr (',' stmtexpr)*)? ';' expr? ';' (stmtexpr (',' stmtexpr)*)? | pmod* type ident dims ':' expr) ')' stmt
switch: 'switch' '(' expr ')' '{' (label+ blockstmt*)* rule* '}'
label: ('case' caseitem (',' caseitem)* | 'default') ':'
rule: ('case' caseitem (',' caseitem)* | 'default') '->' (expr ';' | block | 'throw' expr ';')
caseitem: cond
try: 'try' ('(' resource (';' resource)* ';'? ')')? block ('catch' '(' pmod* type ('|' type)* ident ')' block)* ('finally' block)?
resource: pmod* type ident '=' expr | chain
expr: cond ((ASSIGN | '=') expr)?
lambda: (ident | '(' (lparam (',' lparam)*)? ')') '->' (expr | block)
lparam: ident | param
cond: binary ('?' expr ':' cond)?
binary: unary (binop unary | 'instanceof' 'final'? annotation* type ident?)*
binop: BIN | '<' | '>' | '>' '>' | '>' '>' '>' | '>' '>=' | '>' '>' '>=' | '>=' | '&' | '-' | '+' | '|'
unary: ('+' | '-' | '!' | '~' | '++' | '--' | cast)* (chain ('++' | '--')* | lambda | 'switch' '(' expr ')' '{' (label+ blockstmt*)* rule* '}')
cast: '(' type ('&' type)* ')'
chain: primary suffix*
targs0: '<' types '>'
suffix: '.' targs0? (ident | 'this' | 'class' | 'super') | '.' new | '(' args? ')' | '[' expr ']' | '::' targs0? (ident | 'new')
primary: LIT | ident | 'this' | 'super' | '(' expr ')' | new | (PRIM | 'void') ('[' ']')* ('.' 'class' | '::' 'new') | ident targs? ('.' ident targs?)* ('[' ']')* ('.' 'class' | '::' (ident | 'new'))
new: 'new' annotation* (newtype (dimexpr+ ('[' ']')* | ('[' ']')+ '{' (init (',' init)*)? ','? '}' | '(' args? ')' classbody?) | targs0 newtype '(' args? ')' classbody?)
newtype: PRIM | ident newargs? ('.' annotation* ident newargs?)*
newargs: '<' (targ (',' targ)*)? '>'
dimexpr: '[' expr ']'
args: expr (',' expr)*
ident: NAME | 'record' | 'sealed' | 'permits' | 'var' | 'yield' | 'module' | 'open' | 'requires' | 'exports' | 'opens' | 'uses' | 'provides' | 'to' | 'with' | 'transitive' | 'non'
"""

GO = """
file: package (import ';')* (top ';')*
package: 'package' NAME ';'
import: 'import' (importspec | '(' (importspec (';' importspec)* ';'?)? ')')
importspec: ('.' | NAME)? STR
top: decl | func
decl: 'const' (constspec | '(' (constspec (';' constspec)* ';'?)? ')') | 'var' (varspec | '(' (varspec (';' varspec)* ';'?)? ')') | 'type' (typespec | '(' (typespec (';' typespec)* ';'?)? ')')
constspec: names (type? '=' exprs)?
varspec: names (type ('=' exprs)? | '=' exprs)
typespec: NAME tparams? '='? type
names: NAME (',' NAME)*
tparams: '[' tparam (',' tparam)* ','? ']'
tparam: names constraint
constraint: cterm ('|' cterm)*
cterm: '~'? type
func: 'func' ('(' (param (',' param)* ','?)? ')')? NAME tparams? signature block?
signature: '(' (param (',' param)* ','?)? ')' result?
result: type | '(' (param (',' param)* ','?)? ')'
param: type | NAME? '...' type | NAME type
type: typename | '*' type | '[' ']' type | '[' (expr | '...') ']' type | 'struct' '{' (field (';' field)* ';'?)? '}' | 'func' signature
  | 'interface' '{' (elem (';' elem)* ';'?)? '}' | 'map' '[' type ']' type | 'chan' '<-'? type | '<-' 'chan' type | '(' type ')'
typename: NAME ('.' NAME)? ('[' type (',' type)* ','? ']')?
field: (names type | '*'? typename) STR?
elem: NAME signature | constraint
block: '{' stmts '}'
stmts: stmt? (';' stmt?)*
stmt: decl | simple | 'return' exprs? | 'break' NAME? | 'continue' NAME? | 'goto' NAME | 'fallthrough' | block | if | switch | select | for | 'go' expr | 'defer' expr | NAME ':' stmt?
simple: exprs ('<-' expr | '++' | '--' | (ASSIGN | '=' | ':=') exprs)?
exprs: expr (',' expr)*
if: 'if' (simple (';' expr)? | ';' expr) block ('else' (if | block))?
switch: 'switch' simple? (';' simple?)? '{' (('case' caselist | 'default') ':' stmts)* '}'
caselist: casetype (',' casetype)*
casetype: expr | type
select: 'select' '{' (('case' simple | 'default') ':' stmts)* '}'
for: 'for' ('range' expr | clauses | exprs (('=' | ':=') ('range' expr | exprs clauses) | ASSIGN exprs clauses | ('++' | '--') clauses | '<-' expr clauses | clauses)?)? block
clauses: ';' expr? ';' simple?
expr: unary (binop unary)*
binop: BIN | '*' | '+' | '-' | '&' | '|' | '^'
unary: ('+' | '-' | '!' | '^' | '*' | '&' | '<-' | '~')* chain
chain: primary suffix*
suffix: '.' NAME | '.' '(' (type | 'type') ')' | '[' (':' expr? (':' expr)? | expr ((',' type)* ','? | ':' expr? (':' expr)?) | type (',' type)* ','?) ']' | '(' (args ','?)? ')' | literal
args: (expr | type) (',' (expr | type))* '...'?
primary: LIT | STR | NAME | '(' (expr | type) ')' | 'func' signature block | conv (literal | '(' expr ','? ')')
conv: '[' ']' type | '[' (expr | '...') ']' type | 'struct' '{' (field (';' field)* ';'?)? '}' | 'map' '[' type ']' type | 'chan' '<-'? type | 'interface' '{' (elem (';' elem)* ';'?)? '}' | '<-' 'chan' type
literal: '{' (element (',' element)* ','?)? '}'
element: value (':' value)?
value: expr | literal
"""


def _ecma(holes: dict[str, str | None], names: list[str], soft: list[str], extra: str = "") -> str:
    import re

    def fill(m: re.Match) -> str:
        text = holes[m[1]]
        suffix = m[2] or ""
        return f" {text}{suffix} " if text else " "

    text = re.sub(r"@([A-Z][A-Z0-9]*)([?*]?)", fill, _ECMA)
    text = re.sub(r"\|\s*(?=[|)])", "", text)
    text = re.sub(r"\(\s*\|", "(", text)
    ident = "ident: NAME | " + " | ".join(f"'{w}'" for w in soft)
    anyname = "anyname: ident | " + " | ".join(f"'{w}'" for w in names)
    return "\n".join([text, extra, ident, anyname])


#: Words that a lexer keeps as tokens of their own, by language.
KEYWORDS: dict[str, frozenset[str]] = {
    "python": frozenset(
        "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda "
        "nonlocal not or pass raise return try while with yield match case type _".split()
    ),
    "javascript": frozenset([*_JS_RESERVED, *_JS_SOFT, "enum"]),
    "typescript": frozenset([*_JS_RESERVED, *_JS_SOFT, *_TS_SOFT]),
    "java": frozenset(
        "abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof "
        "interface native new package private protected public return static strictfp super switch synchronized this throw throws transient try "
        "void volatile while record sealed permits var yield module open requires exports opens uses provides to with transitive non".split()
    ),
    "go": frozenset(
        "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct "
        "switch type var".split()
    ),
}


@lru_cache(maxsize=None)
def grammar(language: str) -> Grammar:
    """The grammar of a language of the ``languages`` table."""
    texts = {"json": JSON, "toml": TOML, "yaml": YAML, "python": PYTHON, "java": JAVA, "go": GO}
    if language == "javascript":
        return Grammar(_ecma(_JS_HOLES, _JS_RESERVED + ["enum"], _JS_SOFT), "file")
    if language == "typescript":
        return Grammar(_ecma(_TS_HOLES, [w for w in _JS_RESERVED], _JS_SOFT + [w for w in _TS_SOFT if w != "enum"], _TS_TYPES).replace("anyname: ident |", "anyname: ident | 'enum' |"), "file")
    return Grammar(texts[language], "file")
