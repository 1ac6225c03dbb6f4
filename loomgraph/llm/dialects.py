"""Grammars of the dialects, as text for the recogniser. A region {...} is one token that names what it can be."""

from __future__ import annotations

_EXPR = """
Expr := Assign (',' Assign)* ;
Assign := Tern | Arrow | Left AOp Assign | 'yield' '*'? Assign ;
AOp := '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '&=' | 'bar=' | '^=' | '<<=' | '>>=' | '>>>=' | '&&=' | '||=' | '??=' ;
Left := id | 'yield' | OBJ | Array | '(' Expr ')' | Primary Tail* LTail ;
LTail := '.' Name | '.' priv | '[' Expr ']' ;
Tern := Bin ('?' Assign ':' Assign)? ;
Bin := Unary ((Op | '&&' | '||') Unary)* | Unary ((Op | '??') Unary)* ;
Op := '+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | '&' | 'bar' | '^' | '<<' | '>' '>' | '>' '>' '>' | 'instanceof' | 'in' ;
Unary := Pre* Postfix ;
Pre := '!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' | 'new' ;
Postfix := Primary Tail* ('++' | '--')? ;
Name := id | kw ;
Tail := '.' Name | '.' priv | '?.' Name | '?.' Args | '?.' '[' Expr ']' | '[' Expr ']' | Args | tpl ;
Args := '(' (Arg (',' Arg)* ','?)? ')' ;
Arg := Assign | '...' Assign ;
Primary := id | priv | num | str | tpl | rx | 'this' | 'super' | 'null' | 'true' | 'false' | '(' Expr ')' | Array | OBJ | Func | Class | 'import' | 'yield' | 'new' '.' id ;
Array := '[' ','* (Arg (','+ Arg)*)? ','* ']' ;
Arrow := 'async'? (id | '(' Params ')' Ret?) '=>' (BLOCK | Assign) ;
Params := (Param (',' Param)* ','?)? ;
Param := Deco* '...'? Target ('=' Assign)? ;
Target := (id | PAT | ArrPat) ;
ArrPat := '[' ','* (ArrEl (','+ ArrEl)*)? ','* ']' ;
ArrEl := '...'? Target ('=' Assign)? ;
Func := 'async'? 'function' '*'? id? TParams? '(' Params ')' Ret? BLOCK ;
Class := Deco* 'class' id? TParams? ('extends' Postfix TArgs?)? Impl? CBODY ;
Deco := '@' id ('.' Name)* Args? NL? ;
"""
_STMT = """
Stmts := Stmt* ;
Semi := ';' | NL | '$' ;
Stmt := BLOCK | ';' | NL | Var Semi | 'if' '(' Expr ')' NL? Stmt (NL? 'else' NL? Stmt)? | For NL? Stmt | 'while' '(' Expr ')' NL? Stmt
  | 'do' NL? Stmt NL? 'while' '(' Expr ')' Semi? | 'return' Expr? Semi | 'throw' Expr Semi | ('break' | 'continue') id? Semi | 'debugger' Semi
  | 'try' BLOCK NL? ('catch' ('(' Target ')')? BLOCK)? NL? ('finally' BLOCK)? | 'switch' '(' Expr ')' BLOCK | 'case' Expr ':' | 'default' ':' | id ':' Stmt
  | FuncDecl | Class | Import Semi | Export | Start Semi ;
FuncDecl := Func ;
Start := Expr ;
Var := ('var' | 'let') Decl (',' Decl)* | 'const' CDecl (',' CDecl)* ;
Decl := Target '=' Assign | id ;
CDecl := Target '=' Assign ;
For := 'for' 'await'? '(' ((Var | Expr)? ';' Expr? ';' Expr? | ('var' | 'let' | 'const')? Target ('of' | 'in') Expr | Postfix ('of' | 'in') Expr) ')' ;
Import := 'import' (str | (id (',' ('*' 'as' id | NAMES))? | '*' 'as' id | NAMES) 'from' str) (('with' | 'assert') OBJ)? ;
Export := 'export' (Var Semi | FuncDecl | Class | NAMES ('from' str)? Semi | '*' ('as' Name)? 'from' str Semi | 'default' (Func | Class | Assign Semi)) ;
Members := Member* ;
Mod := 'static' | 'async' | 'get' | 'set' | '*' | 'accessor' ;
MName := Name | priv | str | num | '[' Assign ']' ;
Member := ';' | NL | Deco* Mod* MName ('=' Assign)? Semi | Deco* Mod* MName '(' Params ')' BLOCK | 'static' BLOCK ;
Obj := (Prop (',' Prop)* ','?)? ;
PName := Name | str | num | '[' Assign ']' ;
Prop := PName ':' Assign | id ('=' Assign)? | '...' Assign | ('get' | 'set' | 'async' | '*')* PName '(' Params ')' Ret? BLOCK ;
Pat := (PatProp (',' PatProp)* ','?)? ;
PatProp := id ('=' Assign)? | PName ':' Target ('=' Assign)? | '...' id ;
Names := (Nm (',' Nm)* ','?)? ;
Nm := 'type'? (Name | str) ('as' (Name | str))? ;
"""
JS = _EXPR + _STMT + """
Ret := 'never' ;
TParams := 'never' ;
TArgs := 'never' ;
Impl := 'never' ;
"""
TS = _EXPR + _STMT + """
Import := 'import' 'type' ((id (',' NAMES)? | '*' 'as' id | NAMES) 'from' str) | 'import' id '=' Expr ;
Ret := ':' ('asserts'? id 'is' Type | Type) ;
TParams := '<' TParam (',' TParam)* ','? '>' ;
TParam := ('const' | 'in' | 'out')* id ('extends' Type)? ('=' Type)? ;
TArgs := '<' Type (',' Type)* '>' ;
Impl := 'implements' Type (',' Type)* ;
Target := (id | PAT | ArrPat | 'this') '?'? '!'? ':' Type ;
Param := ('public' | 'private' | 'protected' | 'readonly' | 'override')+ Target ('=' Assign)? | id '?' ;
Tail := '!' | TArgs Args | TArgs tpl ;
Bin := Unary (AnyOp Unary)* Cast+ (AnyOp Unary Cast*)* ;
AnyOp := Op | '&&' | '||' | '??' ;
Cast := 'as' 'const' | ('as' | 'satisfies') Type ;
Pre := '<' Type '>' | '<' 'const' '>' ;
LTail := '!' ;
Decl := id '!'? ':' Type ;
CDecl := id ':' Type ;
Arrow := 'async'? TParams '(' Params ')' Ret? '=>' (BLOCK | Assign) ;
Type := ('bar' | '&')? Uni (('bar' | '&') Uni)* ('extends' Type '?' Type ':' Type)? | FnType ;
FnType := ('abstract'? 'new')? TParams? '(' Params ')' '=>' ('asserts'? id 'is' Type | Type) ;
Uni := ('keyof' | 'typeof' | 'readonly' | 'unique' | 'infer')* Prim ('[' Type? ']')* ;
Prim := id | 'void' | 'null' | 'this' | 'true' | 'false' | str | num | '-' num | tpl | TYPE | '(' Type ')' | '[' (TEl (',' TEl)* ','?)? ']' | QT | 'import' '(' str ')' ('.' id)* TArgs? | 'undefined' ;
QT := id ('.' Name)* TArgs? ;
TEl := '...'? (id '?'? ':')? Type '?'? ;
Types := TMember* ;
TMember := ';' | ',' | NL | TBody TSep ;
TSep := ';' | ',' | NL | '$' ;
TBody := ('readonly' | '+' | '-')* PName '?'? (':' Type)? | ('get' | 'set')? PName '?'? TParams? '(' Params ')' Ret? | 'new'? TParams? '(' Params ')' Ret? | ('readonly' | '-' | '+')* '[' id (':' | 'in') Type ('as' Type)? ']' (('-' | '+')? '?')? (':' Type)? ;
Enum := (PName ('=' Assign)? (',' PName ('=' Assign)?)* ','?)? ;
Stmt := TDecl | 'export' TDecl | 'export' 'default' TDecl | 'export' '=' Expr Semi | 'export' 'as' 'namespace' id Semi | 'export' 'type' NAMES ('from' str)? Semi | 'export' 'import' id '=' Expr Semi ;
TDecl := 'declare' (Var Semi | TDecl | Class | 'async'? 'function' '*'? id TParams? '(' Params ')' Ret? Semi | 'global' BLOCK) | 'interface' id TParams? ('extends' Type (',' Type)*)? TYPE | 'type' id TParams? '=' Type Semi | 'const'? 'enum' id ENUM
  | ('namespace' | 'module') (id ('.' id)* | str) BLOCK | 'abstract' Class | 'async'? 'function' '*'? id TParams? '(' Params ')' Ret? Semi ;
Mod := 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare' ;
Member := Deco* Mod* MName ('?' | '!')? ':' Type ('=' Assign)? Semi | Deco* Mod* MName '?'? TParams? '(' Params ')' Ret? (BLOCK | Semi) | Mod* '[' id ':' Type ']' ':' Type Semi ;
Func := 'async'? 'function' '*'? id? TParams? '(' Params ')' Ret BLOCK ;
"""
JAVA = """
Unit := Decl* ;
Decl := Anno* 'package' QName ';' | 'import' 'static'? QName ('.' '*')? ';' | TypeDecl | ';' | Mod* Type id '(' Params ')' Throws? BLOCK | Mod* Type Vars ';' ;
QName := id ('.' id)* ;
Mod := 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'synchronized' | 'native' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed' | Anno ;
Anno := '@' QName ('(' (AnnArg (',' AnnArg)*)? ')')? ;
AnnArg := (id '=')? (E | AINIT | Anno) ;
TypeDecl := Mod* ('class' id TParams? ('extends' Type)? ('implements' Types)? ('permits' Types)? CBODY | 'interface' id TParams? ('extends' Types)? ('permits' Types)? CBODY
  | 'enum' id ('implements' Types)? CBODY | '@' 'interface' id CBODY | 'record' id TParams? '(' Params ')' ('implements' Types)? CBODY) ;
TParams := '<' Anno* id ('extends' Type ('&' Type)*)? (',' Anno* id ('extends' Type ('&' Type)*)?)* '>' ;
Types := Type (',' Type)* ;
Type := Anno* (prim | id TArgs? ('.' id TArgs?)*) ('[' ']')* ;
TArgs := '<' (TArg (',' TArg)*)? '>' ;
TArg := Type | '?' (('extends' | 'super') Type)? ;
Params := (Param (',' Param)*)? ;
Param := Mod* Type '...'? (id | 'this') ('[' ']')* ;
Throws := 'throws' Types ;
Vars := Var1 (',' Var1)* ;
Var1 := id ('[' ']')* ('=' Init)? ;
Init := E | AINIT ;
Ainit := (Init (',' Init)* ','?)? | ',' ;
Members := Member* ;
Member := ';' | TypeDecl | Mod* TParams? Type id '(' Params ')' ('[' ']')* Throws? (BLOCK | ';' | 'default' Init ';') | Mod* TParams? id '(' Params ')' Throws? BLOCK | Mod* id BLOCK | Mod* Type Vars ';' | 'static'? BLOCK ;
Enumb := (Const (',' Const)* ','?)? (';' Member*)? ;
Const := Anno* id ('(' ArgL? ')')? CBODY? ;
Stmts := Stmt* ;
Stmt := BLOCK | ';' | Mod* Type Vars ';' | SE ';' | 'if' '(' E ')' Stmt ('else' Stmt)? | 'while' '(' E ')' Stmt | 'do' Stmt 'while' '(' E ')' ';' | 'for' '(' ForHead ')' Stmt
  | 'try' ('(' Res (';' Res)* ';'? ')')? BLOCK ('catch' '(' Mod* Type ('bar' Type)* id ')' BLOCK)* ('finally' BLOCK)? | Switch | 'return' E? ';' | 'throw' E ';' | ('break' | 'continue') id? ';'
  | 'synchronized' '(' E ')' BLOCK | 'assert' E (':' E)? ';' | 'yield' E ';' | id ':' Stmt | 'case' Pat (',' Pat)* ('when' E)? (':' | '->' Arm) | 'default' (':' | '->' Arm) | TypeDecl ;
Arm := BLOCK | E ';' | 'throw' E ';' ;
SE := Left AOp E | ('++' | '--') Post | Prim Tail* ('++' | '--') | Prim Tail* Args | New | Prim Tail* '.' New | Switch ;
Left := id | '(' E ')' | Prim Tail* ('.' id | '[' E ']') ;
AOp := '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | 'bar=' | '^=' | '<<=' | '>>=' | '>>>=' | '>' '>=' | '>' '>' '>=' ;
Pat := E | Type id | Type '(' (Pat (',' Pat)*)? ')' | 'default' ;
Switch := 'switch' '(' E ')' BLOCK ;
Res := Mod* Type id '=' E | E ;
ForHead := (Mod* Type Vars | E (',' E)*)? ';' E? ';' (E (',' E)*)? | Mod* Type id ':' E ;
E := Bin ('?' E ':' E)? | Lam | Left AOp E ;
Lam := (id | '(' (Param (',' Param)* | id (',' id)*)? ')') '->' (E | BLOCK) ;
Bin := Unary (Op Unary | 'instanceof' 'final'? Type id?)* (Op Lam)? ;
Op := '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '&&' | '||' | '&' | 'bar' | '^' | '<<' | '>' '>' | '>' '>' '>' ;
Unary := ('!' | '~' | '+' | '-' | '++' | '--' | Cast)* Post | Cast Lam ;
Cast := '(' Type ('&' Type)* ')' ;
Post := Prim Tail* ('++' | '--')? ;
Prim := id | num | str | chr | 'this' | 'super' | 'null' | 'true' | 'false' | '(' E ')' | New | Switch | prim ('[' ']')* | id TArgs ;
New := 'new' Anno* (prim | id TArgs? ('.' id TArgs?)*) (Args CBODY? | ('[' E ']')+ ('[' ']')* | ('[' ']')+ AINIT) ;
Tail := '.' TArgs? (id | 'new' | 'this' | 'class' | 'super') | '[' E ']' | '[' ']' | Args | '::' (id | 'new') ;
Args := '(' ArgL? ')' ;
ArgL := E (',' E)* ;
"""
GO = """
Unit := Decl* ;
Decl := 'package' id ';' | 'import' (str | (id | '.') str | '(' (ISpec ';')* ISpec? ')') ';' | Top ';' | ';' ;
ISpec := (id | '.')? str ;
Top := VarD | 'type' (TSpec | '(' (TSpec ';')* TSpec? ')') | 'func' Recv? id TPars? Sig BLOCK? ;
VarD := ('var' | 'const') (VSpec | '(' (VSpec ';')* VSpec? ')') ;
VSpec := Ids Type? ('=' Es)? ;
Ids := id (',' id)* ;
TSpec := id TPars? '='? Type ;
TPars := '[' id (',' id)* Cons (',' id (',' id)* Cons)* ','? ']' ;
Cons := '~'? Type ('bar' '~'? Type)* ;
Recv := '(' id? '*'? id ('[' Ids ']')? ')' ;
Sig := Pars Res? ;
Res := Type | Pars ;
Pars := '(' (Par (',' Par)* ','?)? ')' ;
Par := id? '...'? Type ;
Type := id ('.' id)? TArgs? | '*' Type | '[' E? ']' Type | '[' '...' ']' Type | 'map' '[' Type ']' Type | 'chan' '<-'? Type | '<-' 'chan' Type | 'func' Sig | 'struct' FIELDS | 'interface' METHODS | '(' Type ')' ;
TArgs := '[' Type (',' Type)* ']' ;
Fields := (Field ';')* Field? ;
Field := Ids Type str? | '*'? id ('.' id)? TArgs? str? ;
Methods := (Meth ';')* Meth? ;
Meth := id Sig | Cons ;
Stmts := (Stmt? ';')* Stmt? ;
Stmt := BLOCK | VarD | 'type' TSpec | Simple | 'return' Es? | ('break' | 'continue' | 'goto') id? | 'fallthrough' | ('go' | 'defer') E | If | 'for' ForH? BLOCK | 'switch' (Simple? ';')? Simple? BLOCK | 'select' BLOCK
  | 'case' (Es | Type (',' Type)* | Simple) ':' Stmt? | 'default' ':' Stmt? | id ':' Stmt? ;
If := 'if' (Simple ';')? E BLOCK ('else' (If | BLOCK))? ;
ForH := E | Simple? ';' E? ';' Simple? | (Es (':=' | '='))? 'range' E ;
Simple := E | Es AOp Es | E ('++' | '--') | E '<-' E | Es ':=' 'range' E ;
AOp := '=' | ':=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | 'bar=' | '^=' | '<<=' | '>>=' | '&^=' ;
Es := E (',' E)* ;
E := U (Op U)* ;
Op := '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '&&' | '||' | '&' | 'bar' | '^' | '<<' | '>' '>' | '&^' ;
U := ('+' | '-' | '!' | '^' | '*' | '&' | '<-')* P ;
P := Base Tail* ;
Base := id | num | str | chr | '(' E ')' | '(' Type ')' | 'func' Sig BLOCK | LType LIT | '[' E? ']' Type | 'map' '[' Type ']' Type | 'struct' FIELDS | 'chan' Type | 'interface' METHODS ;
LType := '[' E? ']' Type | '[' '...' ']' Type | 'map' '[' Type ']' Type | 'struct' FIELDS | id ('.' id)? TArgs? ;
Tail := '.' id | '.' '(' ('type' | Type) ')' | '[' E ']' | '[' Type (',' Type)+ ']' | '[' E? ':' E? (':' E)? ']' | '(' (Arg (',' Arg)* '...'? ','?)? ')' ;
Arg := E | Type ;
Lit := (LEl (',' LEl)* ','?)? ;
LEl := (LV ':')? LV ;
LV := E | LIT ;
"""
CPP = """
Unit := Outer* ;
Stmts := Decl* ;
Members := Outer* ;
Decl := Outer | BLOCK | Stmt ;
Outer := ';' | pp | 'using' 'namespace' QName ';' | 'using' 'typename'? QName ('=' Type)? ';' | 'inline'? 'namespace' QName? Attr? BLOCK | 'namespace' id '=' QName ';' | 'extern' str (BLOCK | Decl) | 'template' '<' TPs? '>' Req? Decl | 'template' Decl
  | 'typedef' Type Dcl ';' | Access ':' | 'friend' Decl | ClassD ';' | 'static_assert' Args ';' | Func | Spec* Type Inits ';' | Spec* Type ';' | 'asm' Args ';' ;
Req := 'requires' E ;
Attr := '[' '[' Es? ']' ']' ;
Access := 'public' | 'private' | 'protected' ;
TPs := TP1 (',' TP1)* ;
TP1 := ('typename' | 'class') '...'? id? ('=' Type)? | Type '...'? id? ('=' Un)? | 'template' '<' TPs? '>' 'class' id? ;
ClassD := Spec* ClassS Inits? | Spec* EnumS Inits? ;
ClassS := ('class' | 'struct' | 'union') Attr? QName? 'final'? (':' BaseC (',' BaseC)*)? CBODY ;
EnumS := 'enum' ('class' | 'struct')? id? (':' Type)? ENUM ;
BaseC := ('virtual' | Access)* QName '...'? ;
Spec := 'static' | 'inline' | 'constexpr' | 'virtual' | 'explicit' | 'extern' | 'mutable' | 'thread_local' | 'register' | 'consteval' | 'constinit' | Attr ;
Func := Spec* (Type Ptr*)? FName '(' Params? ')' FSuf* (':' MemI (',' MemI)*)? (BLOCK | '=' ('default' | 'delete' | num) ';' | 'try' BLOCK Catch+ | ';') ;
FName := QName | QName? '~' id | (QName '::')? 'operator' OpName | 'operator' Type ;
OpName := Op | '(' ')' | '[' ']' | '!' | '~' | '++' | '--' | '->' | 'new' | 'delete' | str id | ',' ;
FSuf := 'const' | 'noexcept' Args? | 'override' | 'final' | '&' | '&&' | '->' Type Ptr* | 'volatile' | Attr | Req ;
MemI := QName (Args | INIT) '...'? ;
Params := Param (',' Param)* (',' '...')? | '...' | 'void' ;
Param := Attr? 'register'? Type Dcl? ('=' (E | INIT))? ;
Type := CV* Core CV* Ptr* ;
CV := 'const' | 'volatile' ;
Core := prim+ | ('typename' | 'struct' | 'class' | 'enum' | 'union')? QName | 'auto' | 'decltype' Args ;
Ptr := ('*' | '&' | '&&') CV* | '...' ;
QName := '::'? Seg ('::' 'template'? Seg)* ;
Seg := id TArgs? ;
TArgs := '<' (TA (',' TA)*)? '>' ;
TA := Type ('(' Params? ')')? '...'? | Un ;
Inits := Init (',' Init)* ;
Init := Ptr* Dcl ('=' (E | INIT) | INIT | Args)? (':' E)? ;
Dcl := Ptr* (id | QName | '(' Ptr+ id? ')' | '[' id (',' id)* ']')? ('[' E? ']')* ('(' Params? ')' FSuf*)? ;
Enum := (id ('=' E)? (',' id ('=' E)?)* ','?)? ;
Initl := (IV (',' IV)* ','?)? ;
IV := ('.' id '=')? (E | INIT) '...'? ;
Stmt := E ';' | 'if' 'constexpr'? '(' Cond ')' Decl ('else' Decl)? | 'while' '(' Cond ')' Decl | 'do' Decl 'while' '(' E ')' ';' | 'for' '(' ForH ')' Decl | 'switch' '(' Cond ')' Decl | 'case' E ':' | 'default' ':' | id ':' Decl
  | 'return' (E | INIT)? ';' | ('break' | 'continue') ';' | 'goto' id ';' | 'try' BLOCK Catch+ | 'co_return' E? ';' ;
Catch := 'catch' '(' (Param | '...') ')' BLOCK ;
Cond := (Spec* Type Inits ';')? (E | Type Init) ;
ForH := (Spec* Type Inits | E)? ';' E? ';' E? | Spec* Type (Dcl | '&') ':' (E | INIT) ;
E := As (',' As)* ;
As := Bin ('?' E ':' As)? | 'throw' As? ;
Bin := Un (Op Un)* (Op INIT)? ;
Es := As (',' As)* ;
Op := '+' | '-' | '*' | '/' | '%' | '=' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<=>' | '&&' | '||' | '&' | 'bar' | '^' | '<<' | '>' '>' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | 'bar=' | '^=' | '<<=' | '>>=' | '.*' | '->*' ;
Un := ('!' | '~' | '+' | '-' | '++' | '--' | '*' | '&' | '&&' | Cast | 'co_await')* Post | New | 'delete' ('[' ']')? Un | 'sizeof' ('(' Type ')' | '...'? Un) ;
Cast := '(' Type ')' ;
Post := Prim Tail* ('++' | '--')? ;
Prim := QName | num | str+ | chr | 'this' | 'nullptr' | 'true' | 'false' | '(' E ')' | Lambda | QName INIT | prim+ (Args | INIT) | NamedCast | 'typeid' '(' (E | Type) ')' | '(' Type ')' INIT | 'auto' ;
NamedCast := ('static_cast' | 'dynamic_cast' | 'const_cast' | 'reinterpret_cast') '<' Type '>' '(' E ')' ;
Lambda := '[' (Capt (',' Capt)*)? ']' ('<' TPs '>')? ('(' Params? ')')? ('mutable' | 'constexpr' | FSuf)* BLOCK ;
Capt := '&' | '=' | '&'? id '...'? ('=' E)? | '*'? 'this' ;
New := '::'? 'new' Args? ('(' Type ')' | Type) ('[' E ']')* (Args | INIT)? ;
Tail := ('.' | '->') 'template'? (QName | '~' id | 'operator' OpName) | '[' E? ']' | Args | INIT ;
Args := '(' (Arg (',' Arg)*)? ')' ;
Arg := (As | INIT | Type) '...'? ;
"""
PYTHON = """
Line := Simple (';' Simple)* ';'? | Head ;
Simple := 'pass' | 'break' | 'continue' | 'return' Stars? | 'raise' (E ('from' E)?)? | 'global' Ids | 'nonlocal' Ids | 'del' Targets | 'assert' E (',' E)? | 'import' Dot ('as' id)? (',' Dot ('as' id)?)*
  | 'from' ('.' | '...')* Dot? 'import' ('*' | Imps | '(' Imps ','? ')') | 'type' id TP? '=' E | Assign ;
Ids := id (',' id)* ;
Dot := id ('.' id)* ;
Imps := id ('as' id)? (',' id ('as' id)?)* ;
TP := '[' Stars ']' ;
Assign := Stars | (Targets '=')+ (Stars | Yield) | One ':' E ('=' (Stars | Yield))? | One Aug (Stars | Yield) | Yield ;
Targets := Target (',' Target)* ','? ;
Target := '*'? (One | '(' Targets? ')' | '[' Targets? ']') ;
One := id | At Tail* ('.' id | '[' Sub (',' Sub)* ','? ']') | '(' One ')' ;
Yield := 'yield' Stars? | 'yield' 'from' E ;
Aug := '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '**=' | '@=' | '&=' | 'bar=' | '^=' | '<<=' | '>>=' ;
Head := Kw (':' | ':' Simple (';' Simple)* ';'?) | '@' Nam ;
Kw := 'if' Nam | 'elif' Nam | 'else' | 'while' Nam | 'async'? 'for' Targets 'in' Stars | 'try' | 'except' '*'? (E ('as' id)? | E (',' E)+)? | 'finally' | 'async'? 'with' Items | 'async'? 'def' id TP? '(' Params ')' ('->' E)?
  | 'class' id TP? ('(' ArgL? ')')? | 'match' Stars | 'case' Pats ('if' Nam)? ;
Items := Item (',' Item)* | '(' Item (',' Item)* ','? ')' ;
Item := E ('as' Target)? ;
Pats := Stars | Pat ('as' id)? (',' Pat)* ;
Pat := E ('bar' E)* ('as' id)? | '*' id ;
Params := (PList ','?)? ;
PList := Plain (',' Rest)? | Rest ;
Plain := P (',' P)* (',' '/' (',' P)*)? (',' D)* | P (',' P)* (',' D)+ ',' '/' (',' D)* | D (',' D)* (',' '/' (',' D)*)? ;
P := id (':' E)? ;
D := P '=' E ;
Rest := '*' id (':' '*'? E)? (',' K)* (',' '**' P)? | '*' (',' K)+ (',' '**' P)? | '**' P ;
K := P ('=' E)? ;
Stars := Star (',' Star)* ','? ;
Star := '*' E | Nam ;
Nam := id ':=' E | E ;
E := Or ('if' Or 'else' E)? | 'lambda' LParams ':' E ;
LParams := (LList ','?)? ;
LList := LPlain (',' LRest)? | LRest ;
LPlain := id (',' id)* (',' '/' (',' id)*)? (',' LD)* | id (',' id)* (',' LD)+ ',' '/' (',' LD)* | LD (',' LD)* (',' '/' (',' LD)*)? ;
LD := id '=' E ;
LRest := '*' id (',' LK)* (',' '**' id)? | '*' (',' LK)+ (',' '**' id)? | '**' id ;
LK := id ('=' E)? ;
Or := Not (Bop Not)* ;
Bop := 'and' | 'or' ;
Not := 'not'* Cmp ;
Cmp := Ar (Cop Ar)* ;
Cop := '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' 'not'? ;
Ar := Un (Aop Un)* ;
Aop := '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' | '&' | 'bar' | '^' | '<<' | '>>' ;
Un := ('+' | '-' | '~')* 'await'? At Tail* ;
At := id | num | str+ | 'None' | 'True' | 'False' | '...' | '(' (Yield | Stars | Nam Comp)? ')' | '[' (Stars | Nam Comp)? ']' | '{' (Dict | Stars | Nam Comp | E ':' E Comp)? '}' ;
Dict := DEl (',' DEl)* ','? ;
DEl := E ':' E | '**' E ;
Comp := ('async'? 'for' Targets 'in' Or ('if' Cond)*)+ ;
Cond := Or | id ':=' E | 'lambda' LParams ':' E ;
Tail := '.' id | '(' ArgL? ')' | '[' Sub (',' Sub)* ','? ']' ;
ArgL := (A1 (',' A1)* (',' A2)* (',' A3)* | A2 (',' A2)* (',' A3)* | A3 (',' A3)*) ','? | Nam Comp ;
A1 := Nam | '*' E ;
A2 := id '=' E | '*' E ;
A3 := id '=' E | '**' E ;
Sub := Nam | '*' E | E? ':' E? (':' E?)? ;
"""
JSON = """
Doc := V ;
V := str | num | 'true' | 'false' | 'null' | OBJ | ARR ;
Obj := (str ':' V (',' str ':' V)*)? ;
Arr := (V (',' V)*)? ;
"""
SHELL = """
List := NL* (Item (Sep Item)* Sep?)? ;
Sep := (';' | '&') NL* | NL+ ;
Item := '!'? Pipe (('&&' | '||') NL* '!'? Pipe)* ;
Pipe := Cmd ('bar' NL* Cmd)* ;
Cmd := c | Comp r* | w '(' ')' NL* Comp r* ;
Comp := '{' L '}' | '(' L ')' | 'if' L 'then' L ('elif' L 'then' L)* ('else' L)? 'fi' | ('while' | 'until') L 'do' L 'done' | 'for' w (NL* 'in' w* Sep | Sep)? NL* 'do' L 'done' | 'case' w NL* 'in' NL* (Arm (';;' NL* Arm)* (';;' NL*)?)? 'esac' ;
Arm := '('? w ('bar' w)* ')' (L | NL*) ;
L := NL* Item (Sep Item)* Sep? ;
"""
YAML = """
Line := Value | Entry ;
Entry := '-' | '-' Line | Key | Key Value ;
Key := Scalar ':' ;
Entry := '?' | '?' Line | ':' | ':' Line ;
Value := Prop* (Scalar | Flow | alias | block)? ;
Prop := tag | anchor ;
Scalar := plain | str ;
Flow := '[' (FV (',' FV)* ','?)? ']' | '{' (FP (',' FP)* ','?)? '}' ;
FV := Prop* (Scalar | Flow | alias) | FP1 ;
FP1 := Prop* (Scalar | Flow) ':' FVal ;
FVal := (Prop* (Scalar | Flow | alias))? ;
FP := Prop* (Scalar | Flow | alias) (':' FVal)? ;
"""
