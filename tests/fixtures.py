"""A small project export with one case of nearly everything."""

PROJECT = """<?xml version="1.0" encoding="UTF-8"?>
<RSLogix5000Content SchemaRevision="1.0" TargetName="Plant" ExportDate="Tue Jan 02 10:00:00 2024">
 <Controller Name="Plant" ProcessorType="1756-L8" MajorRev="33" MinorRev="11">
  <RedundancyInfo Enabled="false"/>
  <DataTypes>
   <DataType Name="UnitT" Family="NoFamily" Class="User"><Description>a unit</Description><Members><Member Name="Run" DataType="BOOL" Radix="Decimal"/><Member Name="Spd" DataType="REAL"/></Members></DataType>
   <DataType Name="LostT" Family="NoFamily" Class="User"><Members><Member Name="X" DataType="DINT"/></Members></DataType>
  </DataTypes>
  <AddOnInstructionDefinitions>
   <AddOnInstructionDefinition Name="Pump" Revision="1.0">
    <Parameters>
     <Parameter Name="EnableIn" Usage="Input" DataType="BOOL"/><Parameter Name="Cmd" Usage="Input" DataType="BOOL" Required="true"/><Parameter Name="Perm" Usage="Input" DataType="BOOL" Required="true"/><Parameter Name="Sts" Usage="Output" DataType="BOOL"/>
    </Parameters>
    <LocalTags><LocalTag Name="Tmr" DataType="TIMER"/></LocalTags>
    <Routines><Routine Name="Logic" Type="RLL"><RLLContent><Rung Number="0" Type="N"><Text>XIC(Cmd)OTE(Sts);</Text></Rung></RLLContent></Routine></Routines>
   </AddOnInstructionDefinition>
   <AddOnInstructionDefinition Name="Spare"><Parameters/></AddOnInstructionDefinition>
  </AddOnInstructionDefinitions>
  <Modules>
   <Module Name="Local" CatalogNumber="1756-L8" ParentModule="Local" Inhibited="false"><Ports><Port Id="1" Address="0" Type="ICP"><Bus Size="10"/></Port></Ports></Module>
   <Module Name="Adapter" CatalogNumber="1756-EN" ParentModule="Local" Inhibited="true"><Ports><Port Id="1" Address="3" Type="ICP"/><Port Id="2" Address="10.0.0.5" Type="Ethernet"/></Ports><Communications><Connections><Connection Name="C1" RPI="20" Type="Input"><InputTag/><OutputTag/></Connection></Connections></Communications></Module>
   <Module CatalogNumber="1756-IB" ParentModule="Adapter"><Ports><Port Id="1" Address="4" Type="ICP"/></Ports><Communications><ConfigTag><EngineeringUnits><EngineeringUnit Operand="CH0">bar</EngineeringUnit></EngineeringUnits></ConfigTag><Connections><RackConnection Name="R1"><InAliasTag><Description>inputs</Description><Comments><Comment Operand=".0">door shut</Comment><Comment Operand=".DATA[3]">level ok</Comment></Comments></InAliasTag></RackConnection></Connections></Communications></Module>
   <Module Name="Stray" ParentModule="Nowhere"><Ports/></Module>
  </Modules>
  <Tags>
   <Tag Name="Start" DataType="BOOL"><Description>start button</Description><Comments><Comment Operand=".x">bit x</Comment><Comment Operand="[0].y">deep y</Comment></Comments></Tag>
   <Tag Name="Motor" DataType="BOOL"/><Tag Name="Lamp" DataType="BOOL"/><Tag Name="Speed" DataType="REAL"/><Tag Name="Ghost" DataType="BOOL"/><Tag Name="Target" DataType="REAL"/>
   <Tag Name="MotorA" TagType="Alias" AliasFor="Motor"/><Tag Name="MotorB" TagType="Alias" AliasFor="MotorA.x"/><Tag Name="Bad" TagType="Alias" AliasFor="Gone.1"/>
   <Tag Name="U1" DataType="UnitT"><Data Format="L5K">[0,1.0]</Data><Data Format="Decorated"><Structure DataType="UnitT"><DataValueMember Name="Run" Value="0"/><ArrayMember Name="A"><Element Index="[0]" Value="1"/></ArrayMember></Structure></Data></Tag>
   <Tag Name="P1" DataType="Pump"/>
   <Tag Name="Alm" DataType="ALARM_DIGITAL"><Data Format="Alarm"><AlarmDigitalParameters Severity="500" AssocTag1="Speed" AssocTag2="SPACE"/><AlarmConfig><AlarmClass>Process</AlarmClass><Messages><Message Type="CAM"><Text Lang="en">too fast</Text><Text Lang="de">zu schnell</Text></Message><Message Type="X"/></Messages></AlarmConfig></Data></Tag>
   <Tag Name="Out" TagType="Produced" DataType="DINT"><ProduceInfo ProduceCount="1" DefaultRPI="5"/></Tag>
   <Tag Name="Msg" DataType="MESSAGE"><Data Format="Message"><MessageParameters MessageType="CIP Generic" ServiceCode="16#0e" ConnectionPath="Adapter"/></Data></Tag>
  </Tags>
  <Programs>
   <Program Name="Main" MainRoutineName="R1">
    <Tags><Tag Name="Local1" DataType="DINT"/></Tags>
    <Routines>
     <Routine Name="R1" Type="RLL"><RLLContent>
      <Rung Number="0" Type="N"><Comment>start it</Comment><Text>XIC(Start)[XIC(Motor),XIC(Ghost)]OTE(Motor);</Text></Rung>
      <Rung Number="1" Type="N"><Text>XIC(Motor)MOV(Speed,Target)OTE(Lamp);</Text></Rung>
      <Rung Number="2" Type="N"><Text>JSR(R2,0)Pump(P1,Start,U1.Run,Lamp)ALMD(Alm,Speed,0,0,0);</Text></Rung>
      <Rung Number="3" Type="N"><Text>BTD(Speed,0,Target,4,8)CPT(Local1,Speed+Target*2)JMP(skip);</Text></Rung>
     </RLLContent></Routine>
     <Routine Name="R2" Type="ST"><STContent><Line Number="0">// Lamp := 1;</Line><Line Number="1">IF Start THEN Speed := Target + MAX(U1.Spd, 3.5);</Line><Line Number="2">END_IF; U1.Run := NOT Motor;</Line></STContent></Routine>
     <Routine Name="F1" Type="FBD"><FBDContent>
      <Sheet Number="1"><IRef ID="0" X="1" Y="1" Operand="Start"/><IRef ID="1" Operand="Motor"/><Block ID="2" Type="BAND" Operand="AND_01"/><OCon ID="3" Name="both"/><Wire FromID="0" ToID="2" ToParam="In1"/><Wire FromID="1" ToID="2" ToParam="In2"/><Wire FromID="2" FromParam="Out" ToID="3"/><TextBox ID="9"><Text>note</Text></TextBox></Sheet>
      <Sheet Number="2"><ICon ID="0" Name="both"/><AddOnInstruction ID="1" Name="Pump" Operand="P1" VisiblePins="Cmd Perm Sts"/><ORef ID="2" Operand="Lamp"/><JSR ID="4" Routine="R2"/><Wire FromID="0" ToID="1" ToParam="Cmd"/><Wire FromID="1" FromParam="Sts" ToID="2"/></Sheet>
      <Sheet Number="3"/>
     </FBDContent></Routine>
     <Routine Name="S1" Type="SFC">
      <SFCContent OnlineEditType="Original"><Step ID="0" Operand="Step_0" InitialStep="true"><Action ID="1" Operand="Act_0" Qualifier="N"><Body><STContent><Line>Motor := Start;</Line></STContent></Body></Action></Step><Transition ID="2" Operand="Tran_0"><Condition><STContent><Line>Speed &gt; 3</Line></STContent></Condition></Transition><DirectedLink FromID="0" ToID="2"/><Branch ID="5" BranchType="Selection" BranchFlow="Diverge"><Leg ID="6"><Step ID="7" Operand="Step_7"/></Leg><Leg ID="8"/></Branch></SFCContent>
      <SFCContent OnlineEditType="Pending"><Step ID="0" Operand="Step_0"/></SFCContent>
     </Routine>
    </Routines>
    <ChildPrograms><ChildProgram Name="Idle"/></ChildPrograms>
   </Program>
   <Program Name="Idle"><Routines><Routine Name="R9" Type="RLL"><RLLContent><Rung><Text>XIC(Lamp)OTE(Motor);</Text></Rung></RLLContent></Routine></Routines></Program>
  </Programs>
  <Tasks><Task Name="T1" Type="CONTINUOUS" Rate="10" Priority="10" Watchdog="500"><ScheduledPrograms><ScheduledProgram Name="Main"/></ScheduledPrograms></Task></Tasks>
  <Trends/><Novelty/>
 </Controller>
</RSLogix5000Content>
"""
