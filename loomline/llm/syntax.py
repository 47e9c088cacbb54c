"""Grammars of Python 3, JavaScript modules, TypeScript, Java and Go for recognition by derivatives.

The grammars follow the public language references. Where the exact rule needs more than a context-free
grammar over tokens (what may be assigned to, duplicate names), they accept a little more than the language.
"""

from __future__ import annotations

import sys
from functools import lru_cache

from loomline.llm import lexers
from loomline.llm.derivatives import Grammar

PYTHON = """
File = { NEWLINE | Stmt } ;
Stmt = Simple NEWLINE | Compound ;
Simple = Small { ';' Small } [ ';' ] ;
Name = ID | 'match' | 'case' | 'type' ;
Small = ExprStmt | 'pass' | 'break' | 'continue' | 'del' Targets | 'return' [ Stars ] | 'raise' [ Expr [ 'from' Expr ] ]
  | 'global' Name { ',' Name } | 'nonlocal' Name { ',' Name } | 'assert' Expr [ ',' Expr ] | Import | 'type' Name [ TypeParams ] '=' Expr ;
Import = 'import' Dotted [ 'as' Name ] { ',' Dotted [ 'as' Name ] }
  | 'from' ( { '.' | '...' } Dotted | ( '.' | '...' ) { '.' | '...' } ) 'import' ( '*' | Froms | '(' Froms [ ',' ] ')' ) ;
Froms = Name [ 'as' Name ] { ',' Name [ 'as' Name ] } ;
Dotted = Name { '.' Name } ;
ExprStmt = Value ( { '=' Value } | ':' Expr [ '=' Value ] | Augmented Value ) ;
Value = 'yield' [ 'from' Expr | Stars ] | Stars ;
Augmented = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '**=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '@=' ;
Stars = Star { ',' Star } [ ',' ] ;
Star = '*' Bin | Expr ;
Compound = If | While | For | Try | With | { Decorator } ( Def | Class ) | 'async' ( For | With ) | Match ;
Decorator = '@' Named NEWLINE ;
Suite = Simple NEWLINE | NEWLINE INDENT Stmt { Stmt } DEDENT ;
If = 'if' Named ':' Suite { 'elif' Named ':' Suite } [ 'else' ':' Suite ] ;
While = 'while' Named ':' Suite [ 'else' ':' Suite ] ;
For = 'for' Targets 'in' Stars ':' Suite [ 'else' ':' Suite ] ;
Try = 'try' ':' Suite ( 'finally' ':' Suite | Except { Except } [ 'else' ':' Suite ] [ 'finally' ':' Suite ] ) ;
Except = 'except' [ '*' ] [ Expr [ 'as' Name ] ] ':' Suite ;
With = 'with' ( WithItem { ',' WithItem } | '(' WithItem { ',' WithItem } [ ',' ] ')' ) ':' Suite ;
WithItem = Expr [ 'as' Target ] ;
Def = [ 'async' ] 'def' Name [ TypeParams ] '(' [ Params ] ')' [ '->' Expr ] ':' Suite ;
Params = Param { ',' Param } [ ',' ] ;
Param = Name [ ':' Expr ] [ '=' Expr ] | '*' [ Name [ ':' Star ] ] | '**' Name [ ':' Expr ] | '/' ;
TypeParams = '[' TypeParam { ',' TypeParam } [ ',' ] ']' ;
TypeParam = Name [ ':' Expr ] [ '=' Expr ] | '*' Name [ '=' Star ] | '**' Name [ '=' Expr ] ;
Class = 'class' Name [ TypeParams ] [ '(' [ Args ] ')' ] ':' Suite ;
Match = 'match' Stars ':' NEWLINE INDENT Case { Case } DEDENT ;
Case = 'case' Patterns [ 'if' Named ] ':' Suite ;
Patterns = Pattern { ',' Pattern } [ ',' ] ;
Pattern = '*' Name | PatOr [ 'as' Name ] ;
PatOr = PatAtom { '|' PatAtom } ;
PatAtom = [ '-' ] NUM [ ( '+' | '-' ) NUM ] | Text | 'None' | 'True' | 'False' | Dotted [ '(' [ PatArg { ',' PatArg } [ ',' ] ] ')' ]
  | '(' [ Patterns ] ')' | '[' [ Patterns ] ']' | '{' [ PatKey { ',' PatKey } [ ',' ] ] '}' ;
PatArg = [ Name '=' ] Pattern ;
PatKey = '**' Name | ( [ '-' ] NUM | Text | 'None' | 'True' | 'False' | Dotted ) ':' Pattern ;
Targets = TargetStar { ',' TargetStar } [ ',' ] ;
TargetStar = [ '*' ] Target ;
Target = Postfix ;
Expr = Lambda | Bin [ 'if' Bin 'else' Expr ] ;
Lambda = 'lambda' [ LParam { ',' LParam } [ ',' ] ] ':' Expr ;
LParam = Name [ '=' Expr ] | '*' [ Name ] | '**' Name | '/' ;
Named = Expr [ ':=' Expr ] ;
Bin = Un { BinOp Un } ;
BinOp = 'or' | 'and' | 'in' | 'not' 'in' | 'is' [ 'not' ] | '<' | '>' | '==' | '>=' | '<=' | '!=' | '|' | '^' | '&' | '<<' | '>>'
  | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' ;
Un = ( '+' | '-' | '~' | 'not' ) Un | [ 'await' ] Postfix ;
Postfix = Atom { '.' Name | '(' [ Args ] ')' | '[' Subs ']' } ;
Subs = Sub { ',' Sub } [ ',' ] ;
Sub = '*' Bin | Named | [ Expr ] ':' [ Expr ] [ ':' [ Expr ] ] ;
Args = Arg { ',' Arg } [ ',' ] ;
Arg = '*' Expr | '**' Expr | Name '=' Expr | Named [ Comp ] ;
Comp = CompFor { CompFor | 'if' CompIf } ;
CompFor = [ 'async' ] 'for' Targets 'in' Bin ;
CompIf = Bin [ ':=' Bin ] ;
Text = STR { STR } | BYTES { BYTES } ;
Atom = Name | NUM | Text | 'None' | 'True' | 'False' | '...'
  | '(' [ 'yield' [ 'from' Expr | Stars ] | Items | StarNamed Comp ] ')' | '[' [ Items | StarNamed Comp ] ']'
  | '{' [ Items | Named Comp | Pair { ',' Pair } [ ',' ] | Expr ':' Expr Comp ] '}' ;
Pair = '**' Bin | Expr ':' Expr ;
Items = StarNamed { ',' StarNamed } [ ',' ] ;
StarNamed = '*' Bin | Named ;
"""

_SCRIPT = """
File = { Item } ;
Item = Import | Export | Stmt ;
Term = ';' | ASI ;
Block = '{' { Stmt } '}' ;
Stmt = Block | ';' | Vars Term | Func | Class | If | For | 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' [ Term ] | Switch | Try
  | 'throw' Expr Term | 'return' [ Expr ] Term | ( 'break' | 'continue' ) [ Ident ] Term | 'debugger' Term | Ident ':' Stmt
  | !( '{' 'function' 'class' ';' 'let' ) Expr Term | Typed ;
Vars = ( 'var' | 'let' | 'const' ) Binding { ',' Binding } ;
Binding = Target Ann [ '=' Assign ] ;
Target = Ident | '[' [ ElPat ] { ',' [ ElPat ] } ']' | '{' [ PropPat { ',' PropPat } [ ',' ] ] '}' ;
ElPat = [ '...' ] Target [ '=' Assign ] ;
PropPat = '...' Target | Ident [ '=' Assign ] | PropName ':' Target [ '=' Assign ] ;
PropName = WORD | STR | NUM | '[' Assign ']' ;
MemberName = PropName | PRIVATE ;
Func = [ 'async' ] 'function' [ '*' ] [ Ident ] TParams '(' [ Params ] ')' Ret Body ;
Params = Param { ',' Param } [ ',' ] ;
If = 'if' '(' Expr ')' Stmt [ 'else' Stmt ] ;
For = 'for' [ 'await' ] '(' ( [ Vars | Expr ] ';' [ Expr ] ';' [ Expr ] | ( 'var' | 'let' | 'const' ) Target ( 'of' Assign | 'in' Expr ) | Lhs ( 'of' Assign | 'in' Expr ) ) ')' Stmt ;
Switch = 'switch' '(' Expr ')' '{' { ( 'case' Expr | 'default' ) ':' { Stmt } } '}' ;
Try = 'try' Block ( 'finally' Block | 'catch' [ '(' Target Ann ')' ] Block [ 'finally' Block ] ) ;
Expr = Assign { ',' Assign } ;
Assign = 'yield' [ '*' ] [ Assign ] | 'async' Ident '=>' ArrowBody | Cond [ AssignOp Assign | '=>' ArrowBody ] ;
ArrowBody = Block | !( '{' ) Assign ;
Cond = Bin [ '?' Assign ':' Assign ] ;
Prefix = '+' | '-' | '!' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' ;
Postfix = Lhs [ '++' | '--' ] ;
Lhs = { 'new' } ( Primary | 'new' '.' ID | 'super' | 'import' ( '(' Assign [ ',' Assign ] [ ',' ] ')' | '.' ID ) ) { Suffix } ;
Args = '(' [ Arg { ',' Arg } [ ',' ] ] ')' ;
Arg = [ '...' ] Assign ;
Template = TPL0 | TPLH Expr { TPLM Expr } TPLT ;
Primary = Ident | 'this' | 'null' | 'true' | 'false' | NUM | STR | REGEX | Template | '[' [ Arg ] { ',' [ Arg ] } ']' | Object | Func | Class | Paren | PRIVATE 'in' Bin ;
Object = '{' [ Prop { ',' Prop } [ ',' ] ] '}' ;
Prop = '...' Assign | Ident [ '=' Assign ] | PropName ':' Assign | Method ;
Method = [ 'async' ] [ '*' ] MemberName Optional TParams '(' [ Params ] ')' Ret Body | ( 'get' | 'set' ) MemberName '(' [ Params ] ')' Ret Body ;
Import = 'import' ( STR | Kind Clause 'from' STR ) [ 'with' Object ] Term ;
Clause = Ident [ ',' ( Star | Names ) ] | Star | Names ;
Star = '*' 'as' Ident ;
Names = '{' [ NameAs { ',' NameAs } [ ',' ] ] '}' ;
NameAs = Kind ( WORD | STR ) [ 'as' ( WORD | STR ) ] ;
Export = 'export' ( '*' [ 'as' ( WORD | STR ) ] 'from' STR Term | Kind Names [ 'from' STR ] Term | Vars Term | Func | Class | Typed
  | 'default' ( Func | Class | !( 'function' 'class' ) Assign Term | Typed ) | ExportMore ) ;
"""

_PLAIN = """
Ident = ID | 'async' | 'of' | 'get' | 'set' | 'as' | 'from' | 'static' ;
Typed = NEVER ;
ExportMore = NEVER ;
Kind = ;
Ann = ;
Ret = ;
TParams = ;
Optional = ;
Body = Block ;
Param = [ '...' ] Target [ '=' Assign ] ;
Bin = Unary { BinOp Unary } ;
BinOp = '+' | '-' | '*' | '/' | '%' | '**' | '<<' | '>' '>' [ '>' ] | '<' | '>' [ '=' ] | '<=' | '==' | '!=' | '===' | '!==' | '&' | '|' | '^' | '&&' | '||' | '??' | 'in' | 'instanceof' ;
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>' '>' [ '>' ] '=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??=' ;
Unary = { Prefix } Postfix ;
Suffix = '.' ( ID | PRIVATE ) | '?.' ( ID | PRIVATE | '[' Expr ']' | Args | Template ) | '[' Expr ']' | Args | Template ;
Paren = '(' Arg { ',' Arg } [ ',' ] ')' | '(' ')' '=>' ArrowBody ;
Class = { '@' Lhs } 'class' [ Ident ] [ 'extends' Lhs ] '{' { Member } '}' ;
Member = ';' | 'static' Block | { '@' Lhs } [ 'static' ] ( Method | MemberName [ '=' Assign ] Term ) ;
"""

_TYPES = """
Ident = ID | 'async' | 'of' | 'get' | 'set' | 'as' | 'from' | 'static' | 'type' | 'declare' | 'namespace' | 'module' | 'abstract' | 'readonly' | 'public'
  | 'private' | 'protected' | 'keyof' | 'infer' | 'is' | 'asserts' | 'satisfies' | 'override' | 'implements' | 'interface' | 'unique' | 'global' | 'accessor' | 'out' ;
Kind = [ 'type' ] ;
Ann = [ '!' ] [ ':' Type ] ;
Ret = [ ':' Type ] ;
Optional = [ '?' | '!' ] ;
Body = Block | Term ;
Param = { '@' Lhs } { Modifier } [ '...' ] ( Target | 'this' ) [ '?' ] [ ':' Type ] [ '=' Assign ] ;
Modifier = 'static' | 'public' | 'private' | 'protected' | 'readonly' | 'override' | 'abstract' | 'declare' | 'accessor' ;
Bin = Unary { BinOp Unary | ( 'as' | 'satisfies' ) ( Type | 'const' ) } ;
BinOp = '+' | '-' | '*' | '/' | '%' | '**' | '<<' | '>' '>' [ '>' ] | '<' | '>' [ '=' ] | '<=' | '==' | '!=' | '===' | '!==' | '&' | '|' | '^' | '&&' | '||' | '??' | 'in' | 'instanceof' ;
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>' '>' [ '>' ] '=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??=' ;
Unary = { Prefix | '<' ( Type | 'const' ) '>' } Postfix ;
Suffix = '.' ( ID | PRIVATE ) | '?.' ( ID | PRIVATE | '[' Expr ']' | [ TArgs ] Args | Template ) | '[' Expr ']' | Args | Template | '!' | TArgs ( Args | Template ) ;
Paren = '(' PItem { ',' PItem } [ ',' ] ')' [ ':' Type '=>' ArrowBody ] | '(' ')' Ret '=>' ArrowBody
  | [ 'async' ] '<' TParam { ',' TParam } [ ',' ] '>' '(' [ Params ] ')' Ret '=>' ArrowBody | 'async' '(' [ Params ] ')' Ret '=>' ArrowBody ;
PItem = [ '...' ] ( Assign | 'this' ) [ '?' ] [ ':' Type [ '=' Assign ] ] ;
Class = { '@' Lhs } [ 'abstract' ] 'class' [ Ident ] TParams [ 'extends' Lhs [ TArgs ] ] [ 'implements' Types ] '{' { Member } '}' ;
Member = ';' | 'static' Block | { '@' Lhs } { Modifier } ( Method | MemberName Optional [ ':' Type ] [ '=' Assign ] Term | Index Term ) ;
Index = '[' Ident ':' Type ']' ':' Type ;
Types = Type { ',' Type } ;
Type = FuncType | Union [ 'extends' Union '?' Type ':' Type ] ;
FuncType = [ 'abstract' ] [ 'new' ] TParams '(' [ Params ] ')' '=>' Type ;
Union = [ '|' | '&' ] TArr { ( '|' | '&' ) TArr } ;
TArr = { 'keyof' | 'unique' | 'readonly' | 'infer' } TPrim { '[' [ Type ] ']' } ;
TPrim = '(' Type ')' | TName [ TArgs ] | [ '-' ] NUM | STR | 'true' | 'false' | 'null' | 'void' | 'this' [ 'is' Type ] | TObj
  | '[' [ TEl { ',' TEl } [ ',' ] ] ']' | 'typeof' ( TName | 'import' '(' STR ')' ) [ TArgs ] | TPL0 | TPLH Type { TPLM Type } TPLT
  | 'import' '(' STR ')' { '.' ID } [ TArgs ] | 'asserts' ( Ident | 'this' ) [ 'is' Type ] | Ident 'is' Type ;
TName = Ident { '.' ID } ;
TEl = [ '...' ] [ Ident [ '?' ] ':' ] Type [ '?' ] ;
TObj = '{' { TMember ( ';' | ',' | ASI ) } [ TMember ] '}'
  | '{' [ [ '+' | '-' ] 'readonly' ] '[' Ident 'in' Type [ 'as' Type ] ']' [ [ '+' | '-' ] '?' ] [ ':' Type ] [ ';' | ',' | ASI ] '}' ;
TMember = [ 'readonly' ] PropName [ '?' ] [ ':' Type ] | PropName [ '?' ] TParams '(' [ Params ] ')' Ret | ( 'get' | 'set' ) PropName '(' [ Params ] ')' Ret
  | [ 'new' ] TParams '(' [ Params ] ')' Ret | [ 'readonly' ] Index ;
TArgs = '<' Type { ',' Type } '>' ;
TParams = [ '<' TParam { ',' TParam } [ ',' ] '>' ] ;
TParam = { 'const' | 'in' | 'out' } Ident [ 'extends' Type ] [ '=' Type ] ;
Typed = [ 'declare' ] ( 'interface' Ident TParams [ 'extends' Types ] TObj | 'type' Ident TParams '=' Type Term
  | [ 'const' ] 'enum' Ident '{' [ EnumItem { ',' EnumItem } [ ',' ] ] '}' | ( 'namespace' | 'module' ) ( TName | STR ) ( '{' { Item } '}' | Term ) | 'global' '{' { Item } '}' )
  | 'declare' ( Vars Term | Func | Class ) | 'import' Kind Ident '=' ( 'ID' | Lhs ) Term ;
EnumItem = ( WORD | STR ) [ '=' Assign ] ;
ExportMore = '=' Assign Term | 'as' 'namespace' Ident Term | Kind '*' 'from' STR Term | 'import' Ident '=' Lhs Term ;
"""

JAVA = """
File = [ { Annot } 'package' Name ';' ] { Import | ';' } { Mods TypeDecl | ';' } ;
Id = ID | 'record' | 'sealed' | 'permits' | 'when' | 'yield' ;
Name = Id { '.' Id } ;
Import = 'import' [ 'static' ] Name [ '.' '*' ] ';' ;
Annot = '@' Name [ '(' [ AnnotArg { ',' AnnotArg } ] ')' ] ;
AnnotArg = [ Id '=' ] AnnotVal ;
AnnotVal = Cond | Annot | '{' [ AnnotVal { ',' AnnotVal } ] [ ',' ] '}' ;
Mods = { Annot | 'public' | 'protected' | 'private' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | ID '-' 'sealed' } ;
TypeDecl = Class | Interface | Enum | Record | '@' 'interface' Id ClassBody ;
Class = 'class' Id [ TypeParams ] [ 'extends' Type ] [ 'implements' Types ] [ 'permits' Types ] ClassBody ;
Interface = 'interface' Id [ TypeParams ] [ 'extends' Types ] [ 'permits' Types ] ClassBody ;
Enum = 'enum' Id [ 'implements' Types ] '{' [ EnumConst { ',' EnumConst } ] [ ',' ] [ ';' { Member } ] '}' ;
EnumConst = { Annot } Id [ Args ] [ ClassBody ] ;
Record = 'record' Id [ TypeParams ] '(' [ Params ] ')' [ 'implements' Types ] ClassBody ;
ClassBody = '{' { Member } '}' ;
Member = ';' | [ 'static' ] Block | Mods ( TypeDecl | [ TypeParams ] ( Type | 'void' ) Id '(' [ Params ] ')' Dims [ 'throws' Types ] ( Block | [ 'default' AnnotVal ] ';' )
  | Type Declarator { ',' Declarator } ';' | [ TypeParams ] Id '(' [ Params ] ')' [ 'throws' Types ] Block | Id Block ) ;
Params = Param { ',' Param } ;
Param = { Annot | 'final' } Type [ { Annot } '...' ] ( Id Dims | [ Id '.' ] 'this' ) ;
Dims = { '[' ']' } ;
Primitive = 'boolean' | 'byte' | 'short' | 'int' | 'long' | 'char' | 'float' | 'double' ;
Type = { Annot } ( Primitive | Id [ TypeArgs ] { '.' { Annot } Id [ TypeArgs ] } ) { { Annot } '[' ']' } ;
Types = Type { ',' Type } ;
TypeArgs = '<' [ TypeArg { ',' TypeArg } ] '>' ;
TypeArg = Type | { Annot } '?' [ ( 'extends' | 'super' ) Type ] ;
TypeParams = '<' TypeParam { ',' TypeParam } '>' ;
TypeParam = { Annot } Id [ 'extends' Type { '&' Type } ] ;
Declarator = Id Dims [ '=' VarInit ] ;
VarInit = Expr | ArrayInit ;
ArrayInit = '{' [ VarInit { ',' VarInit } ] [ ',' ] '}' ;
Block = '{' { BlockStmt } '}' ;
BlockStmt = Local ';' | Mods ( Class | Interface | Enum | Record ) | Stmt ;
Local = { Annot | 'final' } Type Declarator { ',' Declarator } ;
Stmt = Block | ';' | Expr ';' | 'if' '(' Expr ')' Stmt [ 'else' Stmt ] | 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';' | For
  | Switch | Try | 'return' [ Expr ] ';' | 'throw' Expr ';' | ( 'break' | 'continue' ) [ Id ] ';' | 'synchronized' '(' Expr ')' Block
  | 'assert' Expr [ ':' Expr ] ';' | Id ':' Stmt | 'yield' Expr ';' ;
For = 'for' '(' ( [ Local | Exprs ] ';' [ Expr ] ';' [ Exprs ] | { Annot | 'final' } Type Id Dims ':' Expr ) ')' Stmt ;
Exprs = Expr { ',' Expr } ;
Switch = 'switch' '(' Expr ')' '{' { Case } '}' ;
Case = ( 'case' Label { ',' Label } [ 'when' Expr ] | 'default' ) ( ':' { BlockStmt } | '->' ( Expr ';' | Block | 'throw' Expr ';' ) ) ;
Label = Cond | 'default' | Pattern ;
Pattern = { 'final' | Annot } Type ( Id | '(' [ Pattern { ',' Pattern } ] ')' [ Id ] ) ;
Try = 'try' ( Block ( 'finally' Block | Catch { Catch } [ 'finally' Block ] ) | '(' Resource { ';' Resource } [ ';' ] ')' Block { Catch } [ 'finally' Block ] ) ;
Catch = 'catch' '(' { Annot | 'final' } Type { '|' Type } Id ')' Block ;
Resource = { Annot | 'final' } Type Id '=' Expr | Postfix ;
Expr = Lambda | Cond [ AssignOp Expr ] ;
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>' [ '>' ] '=' ;
Lambda = ( Id | '(' [ LambdaParam { ',' LambdaParam } ] ')' ) '->' ( Expr | Block ) ;
LambdaParam = Id | Param ;
Cond = Bin [ '?' Expr ':' ( Lambda | Cond ) ] ;
Bin = Unary { BinOp Unary | 'instanceof' ( Type | Pattern ) } ;
BinOp = '+' | '-' | '*' | '/' | '%' | '<<' | '>' '>' [ '>' ] | '<' | '>' [ '=' ] | '<=' | '==' | '!=' | '&' | '|' | '^' | '&&' | '||' ;
Unary = ( '+' | '-' | '++' | '--' | '!' | '~' ) Unary | '(' Type { '&' Type } ')' ( !( '+' '-' ) Unary | Lambda ) | '(' Primitive Dims ')' Unary | Postfix ;
Postfix = Primary { Select } [ '++' | '--' ] ;
Args = '(' [ Exprs ] ')' ;
Primary = NUM | STR | 'true' | 'false' | 'null' | 'this' [ Args ] | 'super' [ Args ] | '(' Expr ')' | Id [ Args ] | 'new' Creator | Switch
  | ( Primitive | 'void' ) Dims '.' 'class' | Type '::' [ TypeArgs ] ( Id | 'new' ) | Name '[' ']' Dims '.' 'class' ;
Select = '.' ( Id [ Args ] | 'this' | 'class' | 'super' [ Args ] | 'new' Creator | TypeArgs ( Id | 'super' ) Args ) | '[' Expr ']' | '::' [ TypeArgs ] ( Id | 'new' ) ;
Creator = [ TypeArgs ] { Annot } ( Primitive | Id [ TypeArgs ] { '.' Id [ TypeArgs ] } ) ( Args [ ClassBody ] | '[' Expr ']' { '[' Expr ']' } Dims | '[' ']' Dims ArrayInit ) ;
"""

GO = """
File = 'package' ID ';' { ImportDecl ';' } { ( Func | Decl ) ';' } ;
ImportDecl = 'import' ( Spec | '(' [ Spec { ';' Spec } [ ';' ] ] ')' ) ;
Spec = [ '.' | ID ] STR ;
Decl = 'const' ( ConstSpec | '(' [ ConstSpec { ';' ConstSpec } [ ';' ] ] ')' ) | 'var' ( VarSpec | '(' [ VarSpec { ';' VarSpec } [ ';' ] ] ')' )
  | 'type' ( TypeSpec | '(' [ TypeSpec { ';' TypeSpec } [ ';' ] ] ')' ) ;
Ids = ID { ',' ID } ;
ConstSpec = Ids [ [ Type ] '=' Exprs ] ;
VarSpec = Ids ( Type [ '=' Exprs ] | '=' Exprs ) ;
TypeSpec = ID [ TypeParams ] [ '=' ] Type ;
TypeParams = '[' Ids Constraint { ',' Ids Constraint } [ ',' ] ']' ;
Constraint = [ '~' ] Type { '|' [ '~' ] Type } ;
Func = 'func' [ Params ] ID [ TypeParams ] Sig [ Block ] ;
Sig = Params [ Type | Params ] ;
Params = '(' [ Param { ',' Param } [ ',' ] ] ')' ;
Param = [ ID ] [ '...' ] Type ;
Type = ID [ '.' ID ] [ '[' Type { ',' Type } [ ',' ] ']' ] | '*' Type | '[' [ Expr | '...' ] ']' Type | 'map' '[' Type ']' Type | 'chan' [ '<-' ] Type | '<-' 'chan' Type
  | 'func' Sig | Struct | Interface | '(' Type ')' ;
Struct = 'struct' '{' [ Field { ';' Field } [ ';' ] ] '}' ;
Field = Ids Type [ STR ] | [ '*' ] ID [ '.' ID ] [ '[' Type { ',' Type } ']' ] [ STR ] ;
Interface = 'interface' '{' [ Elem { ';' Elem } [ ';' ] ] '}' ;
Elem = ID Sig | Constraint ;
Block = '{' Stmts '}' ;
Stmts = [ Stmt ] { ';' [ Stmt ] } ;
Stmt = Decl | Plain | 'return' [ Exprs ] | ( 'break' | 'continue' ) [ ID ] | 'goto' ID | 'fallthrough' | Block | If | Switch | Select | For | ( 'defer' | 'go' ) Expr | ID ':' [ Stmt ] ;
Plain = Exprs [ ( '=' | ':=' | AssignOp ) Exprs | '++' | '--' | '<-' Expr ] ;
AssignOp = '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=' ;
If = 'if' [ [ Plain ] ';' ] Expr Block [ 'else' ( If | Block ) ] ;
Switch = 'switch' [ [ Plain ] ';' ] [ Plain ] '{' { ( 'case' Exprs | 'default' ) ':' Stmts } '}' ;
Select = 'select' '{' { ( 'case' Plain | 'default' ) ':' Stmts } '}' ;
For = 'for' ( [ Expr ] | [ Plain ] ';' [ Expr ] ';' [ Plain ] | [ Exprs ( '=' | ':=' ) ] 'range' Expr ) Block ;
Exprs = Expr { ',' Expr } ;
Expr = Unary { BinOp Unary } ;
BinOp = '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^' ;
Unary = { '+' | '-' | '!' | '^' | '*' | '&' | '<-' } Primary ;
Primary = Operand { Suffix } ;
Operand = NUM | STR | ID | '(' Expr ')' | 'func' Sig [ Block ] | '[' [ Expr | '...' ] ']' Type | 'map' '[' Type ']' Type | 'chan' [ '<-' ] Type | Struct | Interface ;
Suffix = '.' ID | '.' '(' ( Type | 'type' ) ')' | '[' ( Expr { ',' Expr } [ ',' ] | [ Expr ] ':' [ Expr ] [ ':' Expr ] ) ']' | '(' [ Expr { ',' Expr } [ '...' ] [ ',' ] ] ')' | Literal ;
Literal = '{' [ Item { ',' Item } [ ',' ] ] '}' ;
Item = ( Expr | Literal ) [ ':' ( Expr | Literal ) ] ;
"""

EXTENSIONS = {"py": "python", "js": "javascript", "mjs": "javascript", "ts": "typescript", "java": "java", "go": "go"}
#: After these a line break ends the statement, whatever follows.
RESTRICTED = frozenset(["return", "break", "continue", "throw", "yield"])


@lru_cache(maxsize=8)
def grammar(language: str) -> Grammar:
    """The grammar of a language, with all derivatives this worker has taken so far."""
    # frames of Python calling Python lie on the heap, so nesting of this depth costs memory, no stack
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 200_000))
    if language == "python":
        return Grammar(PYTHON, "File")
    if language == "java":
        return Grammar(JAVA, "File")
    if language == "go":
        return Grammar(GO, "File")
    words = [*lexers.JS_RESERVED, *lexers.JS_CONTEXT]
    if language == "javascript":
        return Grammar(_SCRIPT + _PLAIN, "File", words)
    return Grammar(_SCRIPT + _TYPES, "File", [*words, *lexers.TS_CONTEXT])


def _script_stream(text: str, typed: bool) -> tuple[list[str], list[int], list[bool]]:
    """Tokens of a script with the semicolons that restricted productions force, and where one may be filled in."""
    kinds, at, fresh = lexers.lex_script(text, typed)
    out: list[str] = []
    where: list[int] = []
    can: list[bool] = []
    for k, t in enumerate(kinds):
        if fresh[k] and out and (out[-1] in RESTRICTED or (t in ("++", "--") and out[-1] in (")", "]", "ID", "this"))):
            out.append("ASI")
            where.append(at[k])
            can.append(False)
        out.append(t)
        where.append(at[k])
        can.append(fresh[k] or t == "}")
    return out, where, can


def first_error(text: str | None, language: str) -> tuple[str, int, str] | None:
    """Where a text stops being a sentence of the language: (kind, character offset, token), or None if it is one.

    `kind` is `token` (no sentence goes on with this token) or `end` (the text is cut off). Null, empty and blank
    texts are no error; a byte-order mark is skipped.
    """
    if not text or not text.strip("\ufeff \t\r\n\f"):
        return None
    body = text[1:] if text[0] == "\ufeff" else text
    shift = len(text) - len(body)
    g = grammar(language)
    if language == "python":
        kinds, at, _ = lexers.lex_python(body)
        bad = g.recognise(kinds)
    elif language == "java":
        kinds, at, _ = lexers.lex_java(body)
        bad = g.recognise(kinds)
    elif language == "go":
        kinds, at, _ = lexers.lex_go(body)
        bad = g.recognise(kinds)
    else:
        kinds, at, can = _script_stream(body, language == "typescript")
        bad = g.recognise(kinds, can, "ASI")
    if bad is None:
        return None
    if bad == len(kinds):
        return "end", len(text), ""
    # a token the lexer could not finish runs to the end of the text
    return "token", at[bad] + shift, kinds[bad]
